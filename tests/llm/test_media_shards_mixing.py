import hashlib
import os
import zlib
from collections import Counter

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as mx, sharding as sh, transport_stream as ts

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 40_000), (None, "abc"), (1, "abc"), (5, "x" * 64)]
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("n", [64, 128, 192, 32768, 32832, 70016, *range(64, 2000, 64)])
def test_transport_round_trip(n):
    data = os.urandom(n)
    media = ts.mux(data)
    s = ts.demux(media)
    assert s.payload == data and not s.continuity_errors and not s.table_errors and len(media) % 188 == 0
    assert s.pts == [k * ts.TICKS for k in range(-(-n // ts.UNIT))] and s.random_access[0]


def test_damage_is_noticed():
    media = bytearray(ts.mux(os.urandom(4096)))
    assert ts.demux(bytes(media[: 188 * 5] + media[188 * 6 :])).continuity_errors == 1
    media[20] ^= 1
    assert ts.demux(bytes(media)).table_errors == 1
    with pytest.raises(ValueError):
        ts.demux(bytes(media[:-1]))


def section(table_id, number, body):
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2) + number.to_bytes(2) + bytes([0xC1, 0, 0]) + body
    return head + ts.section_crc(head).to_bytes(4)


def table_packets(pid, *sections):
    """Sections one after another over as many packets as they need."""
    data, out, first = b"".join(sections), b"", True
    while data or first:
        room = 183 if first else 184
        out += bytes([0x47]) + ((0x4000 if first else 0) | pid).to_bytes(2) + bytes([0x10]) + (b"\0" if first else b"") + data[:room].ljust(room, b"\xff")
        data, first = data[room:], False
    return out


def programs_section(*entries):
    return section(0, 1, b"".join(n.to_bytes(2) + (0xE000 | pid).to_bytes(2) for n, pid in entries))


def map_section(number, *streams, info=b""):
    return section(2, number, (0xE000 | streams[0]).to_bytes(2) + (0xF000 | len(info)).to_bytes(2) + info + b"".join(bytes([6]) + (0xE000 | pid).to_bytes(2) + b"\xf0\x00" for pid in streams))


def test_streams_of_other_writers():
    data = os.urandom(70_000)
    body = ts.mux(data)[2 * 188 :]
    at = ts.STREAM_PID
    long = map_section(7, at, *range(0x300, 0x350), info=b"\x05\x04" * 40)
    assert len(long) > 2 * 184
    for tables, found in (
        (table_packets(0, programs_section((0, 0x10), (1, 0x1000))) + table_packets(0x1000, map_section(1, at)), [(1, at, 6)]),  # a network entry first
        (table_packets(0, programs_section((7, 0x1000))) + table_packets(0x1000, long), [(7, k, 6) for k in (at, *range(0x300, 0x350))]),  # a map over three packets
        (table_packets(0, programs_section((1, 0x1000), (2, 0x1000))) + table_packets(0x1000, map_section(1, at), map_section(2, 0x200)), [(1, at, 6), (2, 0x200, 6)]),  # two maps on one PID
        (table_packets(0, programs_section((1, 0x1000), (2, 0x1001))) + table_packets(0x1001, map_section(2, 0x200)) + table_packets(0x1000, map_section(1, at)), [(1, at, 6), (2, 0x200, 6)]),
    ):
        assert ts.programs(tables + body) == (found, 0)
        s = ts.demux(tables + body)
        assert s.payload == data and not s.continuity_errors and not s.table_errors
        # tables come again in the middle
        half = 188 * (len(body) // 376)
        assert ts.demux(tables + body[:half] + tables + body[half:]).payload == data
    second = ts.demux(tables + body + bytes(b ^ (0x01 if k % 188 == 1 else 0) ^ (0x02 if k % 188 == 1 else 0) for k, b in enumerate(body)), pid=0x200)
    assert second.payload == data


def test_duplicates_are_legal_once():
    data = os.urandom(3000)
    media = ts.mux(data)
    twice = media[: 188 * 6] + media[188 * 5 : 188 * 6] + media[188 * 6 :]
    s = ts.demux(twice)
    assert s.payload == data and not s.continuity_errors
    assert ts.demux(media[: 188 * 6] + media[188 * 5 : 188 * 6] * 2 + media[188 * 6 :]).continuity_errors == 1


def test_what_is_missing_is_a_fault():
    media = ts.mux(os.urandom(3000))
    for cut in (media[188:], media[:188] + media[376:], media[:376], media[376:], media[:188]):
        s = ts.demux(cut)
        assert not s.payload and s.table_errors == 1
    two = table_packets(0, programs_section((1, 0x1000), (2, 0x1001))) + table_packets(0x1000, map_section(1, ts.STREAM_PID))
    assert ts.demux(two + media[376:]).table_errors == 1


def test_media_digests(spark):
    got = ts.media_digests(spark.createDataFrame([(*r, 1, "q") for r in ROWS], SCHEMA + ", n_bytes int, feature string")).collect()
    assert len(got) == len(ROWS)
    for r, (i, t) in zip(got, ROWS, strict=True):
        raw = (t or "").encode()
        payload = ts.padded(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(ts.mux(payload)), hashlib.sha256(ts.mux(payload)).hexdigest())
    assert ts.media_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    back = ts.decode_media(ts.encode_media(spark.createDataFrame(ROWS, SCHEMA))).collect()
    assert [(r.doc_id, r.payload) for r in back] == [(i, (t or "").encode()) for i, t in ROWS]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark):
    rows = ROWS + [(k, f"t{k}") for k in range(-500, 500)]
    got = sh.assign_shards(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", shard int")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", jump((-1 if i is None else i) % 2**64, 16), jump((-1 if i is None else i) % 2**64, 17)) for i, t in rows)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert sh.assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_write_shards(spark, tmp_path):
    sh.write_shards(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((str(r.doc_id), r.text or "") for r in back.collect()) == sorted((str(i), t or "") for i, t in ROWS)
    assert all(r.shard == jump((-1 if r.doc_id is None else r.doc_id) % 2**64, 4) for r in back.collect())


def test_write_shards_of_nothing(spark, tmp_path):
    sh.write_shards(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), 4)
    assert spark.read.schema(SCHEMA + ", shard int").parquet(str(tmp_path / "none")).count() == 0


def test_ids_that_are_no_numbers_count_as_null(spark):
    df = spark.createDataFrame([("7", "a b c"), ("x7", "a b c"), (None, "a b c")], "doc_id string, text string").withColumn("source", F.lit("s"))
    assert sorted(str(r.doc_id) for r in sh.assign_shards(df).collect()) == ["7", "None", "None"]
    assert sorted(str(r.doc_id) for r in mx.mix_sources(df).collect()) == ["7", "None", "None"]
    assert sorted(str(r.doc_id) for r in ts.media_digests(df).collect()) == ["7", "None", "None"]


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        rest = total - sum(cap * sizes[n] for n in full)
        level = rest / sum(w[n] for n in free) if free else 0
        over = {n for n in free if level * w[n] > cap * sizes[n] * (1 + 1e-12)}
        if not over:
            return {n: cap * sizes[n] if n in full else level * w[n] for n in names}
        full |= over


@pytest.mark.parametrize("seed", range(2))
def test_mixing(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 10, 50, 400, 1500]))), r.choice(["a", "b", "b", "b", "c", "é", "Z", None])) for i in range(600)]
    rows += [(900 + k, "hot " * 20, "hot") for k in range(300)] + [(5000, None, "tiny"), (5001, "one", "tiny")]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, source string, size string")
    got = mx.mix_sources(df).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    want = targets_by_hand(sizes)
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.size == size[x.doc_id] and x.source_size == sizes[x.source] and 0 <= x.copies <= 3 and x.taken == x.copies * x.size
        assert x.target == pytest.approx(want[x.source], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2.0, 0.01 * t), s
    assert sorted(map(str, got)) == sorted(map(str, mx.mix_sources(df.repartition(7)).collect()))


def test_mixing_rates_are_a_tilt(spark):
    """Against bisection of the dual on the driver."""
    import math

    from sparkloom.llm.scratch import Scratch

    cells = [("a", 10, 5), ("a", 200, 3), ("b", 7, 9), ("b", 900, 2)]
    t = [("a", 650, 1500.0), ("b", 1863, 400.0)]
    state = mx.balance(spark.createDataFrame(cells, "key string, size long, n long"), spark.createDataFrame(t, "key string, source_size long, target double"), Scratch(spark, "test")).collect()
    for x in state:
        words = lambda lam, x=x: sum(n * z * min(3, math.exp(lam * z / x.scale)) for k, z, n in cells if k == x.key)
        assert words(x.lam) == pytest.approx(x.target, rel=1e-5)


def test_mixing_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mx.mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = mx.mix_sources(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_an_unsolved_dual_raises(spark, monkeypatch):
    monkeypatch.setattr(mx, "STEPS", 1)
    df = spark.createDataFrame([(k, "w " * (k + 1), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    with pytest.raises(ArithmeticError):
        mx.mix_sources(df)


def test_rounding_is_one_rule_for_all_sizes(spark):
    """Long documents only, short ones only, both: taken words miss the target by less than the least document that could be taken once more or less."""
    from sparkloom.llm.scratch import Scratch

    r = random.Random(3)
    cells, targets = [], {}
    for key, low, high, m in (("long", 2000, 90_000, 60), ("short", 1, 40, 30), ("both", 1, 90_000, 80), ("single", 700, 701, 1)):
        sizes = sorted(r.sample(range(low, high), m))
        rows = [(key, z, r.randrange(1, 4)) for z in sizes]
        rate = {z: r.uniform(0, 3) for z in sizes}
        targets[key] = sum(n * z * rate[z] for _, z, n in rows)
        cells += [(key, targets[key], z, n, rate[z]) for _, z, n in rows]
    got = mx.round_cells(spark.createDataFrame(cells, "key string, target double, size long, n long, rate double"), Scratch(spark, "test")).collect()
    for key, target in targets.items():
        mine = [x for x in got if x.key == key]
        missed = round(target) - sum(x.copies * x.size for x in mine)
        assert all(0 <= x.copies <= 3 * x.n for x in mine) and len(mine) == sum(c[0] == key for c in cells)
        assert abs(missed) < min(x.size for x in mine if (x.copies < 3 * x.n if missed > 0 else x.copies > 0)), key


def test_targets_of_many_sources(spark):
    from sparkloom.llm.scratch import Scratch

    r = random.Random(4)
    sizes = {f"s{r.randrange(10**6)}é"[: r.randrange(2, 9)]: r.choice([0, 1, 5, 1000, r.randrange(10**7)]) for _ in range(400)} | {None: 77, "": 3}
    rows = [("" if k is None else "=" + k, k, v) for k, v in sizes.items()]
    got = mx.source_targets(spark.createDataFrame(rows, "key string, source string, source_size long").repartition(13), Scratch(spark, "test")).collect()
    want = targets_by_hand(sizes)
    assert {x.key: pytest.approx(x.target, rel=1e-9, abs=1e-6) for x in got} == {"" if k is None else "=" + k: v for k, v in want.items()}


def test_take_copies(spark):
    rows = [(k, "w " * (k % 9 + 1), "ab"[k % 2], k) for k in range(60)] + [(3, "w w w w", "b", 3)] * 2 + [(7, "v v v v v v v v", "b", 1), (None, "n n n", None, 1), (None, None, "a", 1), (61, None, None, 2), (62, "", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_id int")
    got = mx.take_copies(df)
    assert got.columns == df.columns
    count = lambda x: (x.doc_id, len((x.text or "").split()), x.source)
    taken, want = Counter(map(count, got.collect())), Counter()
    for x in mx.mix_sources(df).collect():
        want[(x.doc_id, x.size, x.source)] += x.copies
    assert taken == +want and set(got.collect()) <= set(df.collect())
    again = mx.take_copies(df.repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.collect()))
    assert mx.take_copies(df.where("false")).count() == 0


def test_take_copies_of_a_row_that_repeats(spark, monkeypatch):
    """A third of all rows is one row; its copies come in arrays of a bounded length."""
    monkeypatch.setattr(mx, "AT_ONCE", 7)
    rows = [(1, "same words here", "a")] * 400 + [(k, f"one word {k}", "ab"[k % 2]) for k in range(2, 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(x.doc_id for x in mx.take_copies(df).collect())
    want = Counter()
    for x in mx.mix_sources(df).collect():
        want[x.doc_id] += x.copies
    assert got == +want and got[1] > 50


