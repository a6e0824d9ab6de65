import random

import pytest

from epochlake.schema import PARSE_CODES
from epochlake.sources.wal import report
from epochlake.sources.wal_format import DamagedLog, Scan, durable_of, last_durable, records, repaired, strict_records
from tests.logs import FILES, E, begin, durable_file, end, invalid, put

INSPECTED = {PARSE_CODES[c]: s for c, s in [("ok", "OK"), ("nondurable_entries", "auto"), ("broken_after", "auto"), ("broken_after_marked", "auto"), ("corrupted_durable_entries", "no"), ("unexpected", "no")]}
# file, durable epoch, inspection, repairs by marking, repairs by cutting; None: beyond repair
MATRIX = [
    ("normal", 0x100, "OK", [], []),
    ("normal2", 0x100, "OK", [], []),
    ("nondurable", 0x100, "auto", [(9, "mark")], [(9, "mark")]),
    ("repaired_nondurable", 0x100, "OK", [], []),
    ("zerofill", 0x100, "auto", [(9, "mark")], [(9, "mark"), (9, "cut")]),
    ("truncated_normal_entry", 0x100, "auto", [(9, "mark")], [(9, "mark"), (9, "cut")]),
    ("truncated_epoch_header", 0x100, "no", None, None),
    ("truncated_invalidated_normal_entry", 0x100, "auto", [], [(9, "cut")]),
    ("truncated_invalidated_epoch_header", 0x100, "OK", [], []),
    ("allzero", 0x100, "auto", [(0, "mark")], [(0, "cut")]),
    ("marker_end_only", 0x100, "OK", [], []),
    ("end_then_entry", 0x100, "no", None, None),
    ("end_then_begin", 0x100, "auto", [(60, "mark")], [(60, "mark")]),
    ("end_then_invalid", 0x100, "OK", [], []),
    ("end_then_short_entry", 0x100, "no", None, None),
    ("short_end_only", 0x100, "no", None, None),
    ("begin_partial_zerofill", 0x100, "auto", [(0, "mark")], [(0, "cut")]),
    ("begin_then_zerofill", 0x100, "no", None, None),
    ("begin_then_zerofill", 0xFF, "auto", [(0, "mark")], [(0, "mark"), (0, "cut")]),
    ("entry_partial_zerofill", 0x100, "no", None, None),
    ("entry_partial_zerofill", 0xFF, "auto", [(0, "mark")], [(0, "mark"), (0, "cut")]),
    ("entry_then_zerofill", 0x100, "no", None, None),
    ("entry_then_zerofill", 0xFF, "auto", [(0, "mark")], [(0, "mark"), (0, "cut")]),
    ("end_partial_zerofill", 0x100, "no", None, None),
    ("end_partial_zerofill", 0xFF, "auto", [(0, "mark")], [(0, "mark"), (0, "cut")]),
    ("allzero", 0xFF, "auto", [(0, "mark")], [(0, "cut")]),
]


@pytest.mark.parametrize("name,durable,inspected,mark,cut", MATRIX)
def test_outcomes(name, durable, inspected, mark, cut):
    data = FILES[name]
    assert INSPECTED[report("pwal_0000", data, durable)["parse_code"]] == inspected
    for policy, wanted in (("mark", mark), ("cut", cut)):
        found = report("pwal_0000", data, durable, policy, assume_detached=True)
        if wanted is None:
            assert INSPECTED[found["parse_code"]] == "no" and not found["repairs"]
            continue
        repairs = [(r["offset"], r["action"]) for r in found["repairs"]]
        assert repairs == wanted
        assert found["parse_code"] == PARSE_CODES["repaired" if wanted else "ok"]
        mended = repaired(data, repairs)
        again = report("pwal_0000", mended, durable, policy, assume_detached=True)
        assert again["parse_code"] == PARSE_CODES["ok"] and not again["repairs"]  # a second repair changes nothing


def test_counts_and_epochs():
    assert report("pwal_0000", FILES["normal2"], 0x100)["counted"] == 3
    assert report("pwal_0000", FILES["repaired_nondurable"], 0x100)["counted"] == 2
    assert report("pwal_0000", FILES["nondurable"], 0x100)["max_epoch"] == 0x101
    assert report("pwal_0000", FILES["truncated_invalidated_normal_entry"], 0x100)["max_epoch"] == 0x101
    blob = begin(1) + put(blobs=[1, 2]) + put()
    assert (report("pwal_0000", blob, 1)["counted"], report("pwal_0000", blob, 1)["entries"]) == (1, 2)


def test_round_trip_and_truncation_anywhere():
    data = begin(1) + put(b"k", b"v", 1, 1, 2**63, [5, 2**64 - 1]) + end(1) + invalid(2) + E + begin(3) + put(b"", b"")
    whole = list(records(data))
    assert [r.kind for r in whole] == ["marker_begin", "normal_with_blob", "marker_end", "marker_invalidated_begin", "normal_entry", "marker_begin", "normal_entry"]
    assert whole[1].blob_ids == [5, 2**64 - 1] and whole[1].minor == 2**63
    for n in range(len(data)):
        found = list(records(data[:n]))
        clean = [r for r in found if not r.torn]
        assert clean == whole[: len(clean)] and sum(r.torn for r in found) == (n not in {0, *(r.end for r in whole)})
    with pytest.raises(DamagedLog):
        list(strict_records(data[:-1]))


def test_random_bytes_never_crash():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choices(range(12), k=rng.randrange(60)))
        for policy in ("report", "mark", "cut"):
            report("pwal_0000", data, 5, policy)


def test_states():
    scan = Scan(FILES["repaired_nondurable"], 0xFF)
    assert [(number, epoch, state) for _, number, epoch, state in scan.entries()] == [(0, 0xF0, "valid"), (1, 0xF1, "invalidated"), (2, 0x100, "nondurable")]


def test_durable_epoch():
    assert last_durable(durable_file(0, 0xFF, 0x100, 3)) == 0x100
    assert last_durable(b"") is None
    assert durable_of(b"", [durable_file(5), durable_file(9, 2)]) == 9
    assert durable_of(durable_file(4), [durable_file(9)]) == 4
    assert durable_of(None, []) == 0
    for bad in (durable_file(1)[:5], begin(1)):
        with pytest.raises(DamagedLog):
            last_durable(bad)


def test_the_fast_loop_reads_what_scan_reads_and_stops_where_records_are_not_sound():
    from epochlake.functions.versions import signed
    from epochlake.schema import POINTS, PUTS
    from epochlake.sources.wal_format import Scan, entry, sound_entries

    far = (1 << 64) - 1
    mixed = begin(1) + put(b"", b"") + entry("remove_entry", far, b"k", far, 1 << 63) + end(1) + begin(far) + put(blobs=[1, far]) + invalid(3) + entry("clear_storage", 9, major=2) + begin(0x101) + put(b"x" * 300, b"") + end(0x101)
    rng = random.Random(3)
    files = [*FILES.values(), mixed, *[mixed[:n] for n in range(len(mixed))], *[bytes(b if rng.random() > 0.01 else rng.randrange(12) for b in mixed) for _ in range(500)]]
    stopped = 0
    for data in files:
        want = [(r.offset, n, signed(e), state, r.kind, signed(r.storage_id), r.key if r.kind in POINTS else None, signed(r.major), signed(r.minor), r.value if r.kind in PUTS else None, [signed(b) for b in r.blob_ids]) for r, n, e, state in Scan(data, 0x100).entries()]
        got, odd = [], None
        for part in sound_entries(data, 0x100, 3):
            if isinstance(part, int):
                odd = part
            else:
                got += [(*row[:-1], list(row[-1])) for row in zip(*part, strict=True)]
        assert got == [w for w in want if odd is None or w[0] < odd]
        if odd is None:
            scan = Scan(data, 0x100)
            assert len(got) == sum(1 for _ in scan.entries()) and all(f.kind == "nondurable" for f in scan.findings)
        stopped += odd is not None
    assert 0 < stopped < len(files)


def test_decode_goes_on_behind_the_first_odd_record():
    from epochlake.sources.wal import decode

    data = begin(1) + E + end(1) + E + begin(2) + put(b"b") + begin(0x101) + put(b"c")
    rows = lambda **options: [(r["key"], r["snippet_epoch"]) for b in decode("pwal_0000", data, 0x100, on_damage="skip", **options) for r in b.to_pylist()]
    assert rows() == [(b"1234", 1), (b"b", 2), (b"c", 0x101)]
    assert rows(on_nondurable="skip") == rows(most_epoch=0x100) == rows()[:2]
