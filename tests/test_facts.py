"""LWW facts, clocks, queues, stores, tables and sketches against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import binary
from factloom.functions.hashing import fnv1a32
from factloom.operators import agenda, clock, log, lww, mapping, ordering, pending, sketches, store, table

LOG = "namespace string, entity long, component string, value double, hlc struct<wall:bigint,logical:bigint,node_id:bigint>, seq long"


def facts(df):
    return {(r.entity, r.component): r.value for r in df.collect()}


def entry(value, wall, logical=0, node=1, seq=0, entity=1):
    return ("test", entity, "c", float(value), (wall, logical, node), seq)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([entry(1, 100, seq=0), entry(2, 200, seq=1)], 2),  # newer wins
        ([entry(1, 200, seq=0), entry(2, 100, seq=1)], 1),  # older is rejected
        ([entry(1, 100, seq=0), entry(2, 100, seq=1)], 1),  # equal is rejected
        ([entry(1, 100, node=1, seq=0), entry(2, 100, node=2, seq=1)], 2),  # node breaks ties
        ([entry(1, 100, logical=5, seq=0), entry(2, 100, logical=4, node=9, seq=1)], 1),  # logical before node
        ([entry(1, 100, logical=900, seq=0), entry(2, 101, seq=1)], 2),  # wall dominates
    ],
)
def test_who_wins(spark, rows, want):
    df = spark.createDataFrame(rows, LOG)
    assert facts(lww.latest(df)) == {(1, "c"): want}
    taken = {r.seq: r.accepted for r in lww.accepted(df).collect()}
    assert taken == {0: True, 1: want == 2}


def test_fold_equals_sequential(spark):
    draw = random.Random(1)
    rows = [entry(k, draw.randrange(20), draw.randrange(3), draw.randrange(2), k, draw.randrange(6)) for k in range(400)]
    state, accepted, previous = {}, {}, {}
    for _, e, c, v, h, s in rows:
        accepted[s] = (e, c) not in state or h > state[e, c][1]
        if accepted[s]:
            previous[s] = state.get((e, c), (None,))[0]
            state[e, c] = (v, h)
    df = spark.createDataFrame(rows, LOG)
    assert facts(lww.latest(df)) == {k: v for k, (v, _) in state.items()}
    assert {r.seq: r.accepted for r in lww.accepted(df).collect()} == accepted
    assert {r.seq: r.previous for r in lww.undo(df).collect()} == previous
    halves = [lww.latest(df.where(f"seq % 2 = {k}")) for k in (0, 1)]
    assert {k[0] for k in facts(lww.merge(*halves))} == {k[0] for k in state}
    top = lww.latest_timestamp(lww.latest(df)).first()
    assert tuple(top.hlc) == max(h for _, h in state.values())
    assert lww.latest_timestamp(df.limit(0)).count() == 0


def test_clock_sends(spark):
    ticks = spark.createDataFrame([("n", 0, 5000), ("n", 1, 5000), ("n", 2, 5001), ("n", 3, 4000)], "node string, seq long, now long")
    got = [(r.wall, r.logical) for r in clock.send(ticks).orderBy("seq").collect()]
    assert got == [(5000, 0), (5000, 1), (5001, 0), (5001, 1)]
    seeds = spark.createDataFrame([("n", 5000, 7)], "node string, wall long, logical long")
    got = [(r.wall, r.logical) for r in clock.send_after(ticks, seeds).orderBy("seq").collect()]
    assert got == [(5000, 8), (5000, 9), (5001, 0), (5001, 1)]


def test_clock_receives(spark):
    draw = random.Random(2)
    rows, want = [], {}
    for node in "ab":
        wall = logical = 0
        for seq in range(40):
            now, rw, rl = draw.randrange(1, 30), draw.randrange(1, 30), draw.randrange(5)
            top = max(now, wall, rw)
            logical = max(logical, rl) + 1 if top == wall == rw else logical + 1 if top == wall else rl + 1 if top == rw else 0
            wall = top
            rows.append((node, seq, now, rw, rl))
        want[node] = (wall, logical)
    df = spark.createDataFrame(rows, "node string, seq long, now long, remote_wall long, remote_logical long")
    assert {r.node: (r.wall, r.logical) for r in clock.receive(df).collect()} == want


@pytest.mark.parametrize(("low", "high"), [(1, 6), (-3, 1), (0, 3)])
def test_clock_receives_without_arrays(spark, low, high):
    draw = random.Random(high)
    rows, want = [], {}
    for node in range(60):
        wall = logical = 0
        for seq in range(draw.randint(1, 9)):
            now, rw, rl = draw.randint(low, high), draw.randint(low, high), draw.randrange(5)
            top = max(now, wall, rw)
            logical = max(logical, rl) + 1 if top == wall == rw else logical + 1 if top == wall else rl + 1 if top == rw else 0
            wall = top
            rows.append((node, seq, now, rw, rl))
        want[node] = (wall, logical)
    got = clock.receive(spark.createDataFrame(rows, "node long, seq long, now long, remote_wall long, remote_logical long").repartition(3))
    assert {r.node: (r.wall, r.logical) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("capacity", [0, 1, 2, 8, 300])
def test_queue_in_ranges(spark, capacity):
    """One key with more operations than a range, others with few; no array has a key's whole history."""
    draw = random.Random(capacity)
    rows, want = [], {}
    for key, n in enumerate([20_000, *(draw.randint(1, 20) for _ in range(40))]):
        size = refused = empty = 0
        for seq in range(n):
            push = draw.random() < (0.7 if seq // 3000 % 2 else 0.4)
            full, none = push and size >= capacity, not push and size == 0
            refused, empty, size = refused + full, empty + none, size if full or none else size + (1 if push else -1)
            rows.append((key, seq, "push" if push else "pop"))
        want[key] = (size, refused, empty)
    got = pending.queue_fold(spark.createDataFrame(rows, "entity long, seq long, op string").repartition(3), capacity)
    assert {r.entity: (r.size, r.refused, r.empty) for r in got.collect()} == want
    assert "shiftright(__n" in got._jdf.queryExecution().optimizedPlan().toString()


def test_numbered(spark):
    rows = [(k * 37 % 101,) for k in range(101)]
    got = ordering.numbered(spark.createDataFrame(rows, "v long"), "v").collect()
    assert sorted((r.v, r.row_id) for r in got) == [(k, k) for k in range(101)]
    assert ordering.numbered(spark.createDataFrame([], "v long"), "v").count() == 0


def test_mappers(spark):
    docs = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"name": "x", "k": "9"}'), (3, "no json"), (4, None), (5, "{}")], "id long, payload string")
    mappers = {"a": mapping.json_mapper("k bigint", ["k"]), "b": mapping.json_mapper("name string", ["name"])}
    assert {(r.id, r.component) for r in mapping.fan_out(docs, mappers).collect()} == {(1, "a"), (2, "b")}
    assert {r.id for r in mapping.declined(docs, mappers).collect()} == {3, 4, 5}
    kinds = spark.createDataFrame([("true",), ("7",), ("2.5",), ('"s"',), ("[1]",), ('{"a":1}',), ("{",)], "t string").select(mapping.tag("t"))
    assert [r[0] for r in kinds.collect()] == ["bool", "int", "float", "bytes", "bytes", "bytes", None]
    either = docs.select("id", mapping.untagged("payload", {"count": "k bigint", "named": "name string"}).alias("u")).orderBy("id").collect()
    assert [r.u and r.u.variant for r in either] == ["count", "named", None, None, None]


def test_agenda_order(spark):
    dirty = spark.createDataFrame([(0, 1, "x"), (1, 1, "x"), (2, 2, "y")], "dirty_id long, entity long, component string")
    watchers = spark.createDataFrame([("x", 0), ("x", 1), ("x", 2)], "component string, rule_id long")
    rules = spark.createDataFrame([(0, "a", 5), (1, "b", 20), (2, "c", 5)], "rule_id long, name string, priority int")
    woken = agenda.agenda(dirty, watchers, rules)
    assert [r.rule_id for r in woken.where("dirty_id = 0").orderBy("place").collect()] == [1, 0, 2]
    assert agenda.coalesced(woken).count() == 3
    assert [r.dirty_id for r in agenda.unwatched(dirty, watchers).collect()] == [2]


def test_queue_and_pending(spark):
    ops = [("push",)] * 10 + [("pop",)] * 12
    df = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], "entity long, seq long, op string")
    assert tuple(pending.queue_fold(df, 8).first()) == (1, 0, 2, 4)
    left = pending.remove_last(df, df.where("op = 'pop'").limit(1), ["entity", "op"])
    assert left.count() == 21 and left.agg(F.max("seq")).first()[0] == 20
    rows = [entry(1, 100, seq=0), entry(2, 50, seq=1), entry(3, 200, seq=2)]
    waiting = pending.pending_ids(spark.createDataFrame(rows, LOG))
    assert sorted((r.id, r.value) for r in waiting.collect()) == [(1, 1.0), (2, 3.0)]  # the older one is no work
    acks = spark.createDataFrame([(1,), (99,)], "id long")
    assert [r.id for r in pending.acknowledge(waiting, acks).collect()] == [2]
    assert pending.following(waiting).first().id == 1


def test_store_is_scoped_by_module(spark):
    ops = [("ns", "a", "k", "set", "1", 0), ("ns", "b", "k", "set", "2", 1), ("ns", "a", "k", "delete", None, 2), ("ns", "a", "k", "delete", None, 3), ("ns", "b", "k", "set", "", 4)]
    df = spark.createDataFrame(ops, "namespace string, module string, key string, op string, value string, seq long")
    assert [(r.module, r.value) for r in store.state(df).collect()] == [("b", "")]
    assert [r.existed for r in store.deletions(df).orderBy("seq").collect()] == [True, False]


def test_table(spark):
    rows = spark.createDataFrame([("u1", 10, 0), ("u2", 20, 1), ("u1", 30, 2), ("u3", 40, 3)], "key string, val long, row_id long")
    assert [r.val for r in table.row_range(rows, 1, 3).orderBy("row_id").collect()] == [20, 30, 40]
    with pytest.raises(IndexError):
        table.row_range(rows, 1, 4)
    with pytest.raises(ValueError):
        table.row_range(rows, 3, 1)
    assert table.last_value(rows, "val").first().val == 40 and table.last_value(rows.limit(0), "val").count() == 0
    assert {r.key: r.val for r in table.by_key(rows, "key").collect()} == {"u1": 30, "u2": 20, "u3": 40}


def test_sketches(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "p long") for ks in ([1, 5, 70_000], [5, 9]))
    assert sketches.bits_set(sketches.bitmap(a.withColumn("g", F.lit(1)), "p", ["g"]), ["g"]).first().n == 3
    for how, want in (("and", {5}), ("or", {1, 5, 9, 70_000}), ("xor", {1, 9, 70_000}), ("andnot", {1, 70_000})):
        assert {r.p for r in sketches.combine(a, b, how).collect()} == want
    words = spark.createDataFrame([(w,) for w in ["hello", "world", "foo", "bar"]], "w string")
    kept = sketches.bloom_semi_join(words, words.where("w <> 'bar'"), "w", size=100)
    assert {r.w for r in kept.collect()} == {"hello", "world", "foo"}


def test_bytes_of_bitmaps(spark):
    bits = lambda *on: bytes(sum(1 << p % 8 for p in on if p // 8 == k) for k in range(2))
    df = spark.createDataFrame([(bits(0, 3, 9), bits(3, 15))], "a binary, b binary")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        sketches.bit_op(a, b, "and"), sketches.bit_op(a, b, "or"), sketches.bit_op(a, b, "xor"), sketches.bit_op(a, b, "andnot"), sketches.bit_not(a),
        sketches.bit_range(a, F.lit(2), F.lit(10), True), sketches.bit_range(a, F.lit(-4), F.lit(8), False), sketches.bit_range(a, F.lit(5), F.lit(99), False),
    ).first()
    assert [bytes(x) for x in got] == [
        bits(3), bits(0, 3, 9, 15), bits(0, 9, 15), bits(0, 9), bits(*set(range(16)) - {0, 3, 9}), bits(0, *range(2, 11)), bits(9), bits(0, 3),
    ]
    assert list(df.select(*(sketches.bit_get(a, F.lit(k)) for k in (-1, 0, 1, 9, 15, 16))).first()) == [False, True, False, True, False, False]


def test_binary_and_literals(spark):
    df = spark.createDataFrame([(0x01020304, "ab")], "n long, s string")
    n = F.col("n")
    got = df.select(binary.big_endian(n, 4), binary.little_endian(n, 4), binary.length_prefixed(F.encode("s", "UTF-8")), binary.from_big_endian(binary.big_endian(n, 4)), binary.from_little_endian(binary.little_endian(n, 8), 8)).first()
    assert [bytes(x) for x in got[:3]] == [b"\1\2\3\4", b"\4\3\2\1", b"\2\0\0\0ab"] and list(got[3:]) == [0x01020304] * 2
    cases = [('"x y"', "str", "x y"), ("x", "str", None), ("true", "bool", True), ("yes", "bool", None), ("-3", "int", -3), ("-3", "uint", None), ("12", "uint", 12), ("1.5", "float", 1.5), ("inf", "float", None), ("1e999", "float", None), ("q", "float", None)]
    for text, kind, want in cases:
        assert spark.range(1).select(binary.literal(F.lit(text), kind)).first()[0] == want


def test_every_receipt_has_a_stamp(spark):
    draw = random.Random(6)
    rows = [(n, k, draw.randint(0, 3), draw.randint(0, 4), draw.randint(0, 2)) for n in range(4) for k in range(60)]
    got = {(r.node, r.seq): (r.wall, r.logical) for r in clock.received(spark.createDataFrame(rows, "node long, seq long, now long, remote_wall long, remote_logical long")).collect()}
    state = {}
    for n, k, now, rw, rl in rows:
        wall, logical = state.get(n, (0, 0))
        top = max(now, wall, rw)
        logical = max(logical, rl) + 1 if top == wall == rw else logical + 1 if top == wall else rl + 1 if top == rw else 0
        state[n] = (top, logical)
        assert got[n, k] == state[n]


def test_store_requests(spark):
    held = spark.createDataFrame([("n", "m", "k", ""), ("n", "m", "j", "42")], "namespace string, module string, key string, value string")
    asked = spark.createDataFrame([("n", "m", "k"), ("n", "m", "j"), ("n", "x", "j"), ("n", "m", "")], "namespace string, module string, key string")
    assert {(r.module, r.key): (r.status, r.value, r.length) for r in store.get(held, asked).collect()} == {("m", "k"): (0, "", 0), ("m", "j"): (0, "42", 2), ("x", "j"): (1, None, None), ("m", ""): (1, None, None)}


def test_log_limits_and_namespaces(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y" * 20, 1), ("", "z", 2), ("b", "w", 3), ("b", "v", 3)], "namespace string, value string, record long")
    assert {r.value for r in log.within_limits(rows, field=10).collect()} == {"x", "w", "v"}
    assert {r.value for r in log.within_limits(rows, field=10, batch="record", mutations=1).collect()} == set()
    assert log.of_namespace(rows, "b").count() == 2 and log.of_namespace(rows, None).count() == 5


def test_defaults_of_fields(spark):
    df = spark.createDataFrame([('{"t": 4.5}',), ('{"t": "warm", "u": null}',), ("no json",), (None,)], "p string")
    got = df.select(mapping.field_or("p", "t", 0.0), mapping.field_or("p", "u", "C")).collect()
    assert [tuple(r) for r in got] == [(4.5, "C"), (0.0, "C"), (0.0, "C"), (0.0, "C")]


def test_fnv(spark):
    def plain(raw):
        h = 2166136261
        for byte in raw:
            h = (h ^ byte) * 16777619 % 2**32
        return h

    texts = ["", "a", "foobar", "größe €", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a32("t").alias("h")).collect()
    assert [r.h for r in got] == [plain(t.encode()) for t in texts]


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([entry(1, 100, seq=0), entry(2, 50, seq=1), entry(3, 200, seq=2)], LOG).withColumns({"kind": F.lit("put"), "acks": F.lit(None).cast("long")})
    log.append(rows, str(tmp_path / "log"))
    log.append(rows.where("seq = 0").withColumns({"kind": F.lit("ack"), "acks": F.col("seq")}), str(tmp_path / "log"))
    kept, waiting = log.replay(spark.read.parquet(str(tmp_path / "log")))
    assert facts(kept) == {(1, "c"): 3.0} and [r.seq for r in waiting.collect()] == [2]
    log.compact(spark, str(tmp_path / "log"), str(tmp_path / "facts"))
    assert facts(spark.read.parquet(str(tmp_path / "facts"))) == {(1, "c"): 3.0}
    assert log.within_limits(rows, field=2).count() == 0


def test_compacted_log_replays_the_same(spark, tmp_path):
    draw = random.Random(4)
    rows = [entry(k, draw.randrange(30), draw.randrange(3), 1, k, draw.randrange(12)) for k in range(150)]
    puts = spark.createDataFrame(rows, LOG).withColumns({"kind": F.lit("put"), "acks": F.lit(None).cast("long")})
    log.append(puts, str(tmp_path / "log"))
    log.append(puts.where("seq % 3 > 0").withColumns({"kind": F.lit("ack"), "acks": F.col("seq")}), str(tmp_path / "log"))
    log.compact(spark, str(tmp_path / "log"), str(tmp_path / "small"))
    whole, small = (spark.read.parquet(str(tmp_path / n)) for n in ("log", "small"))
    for a, b in zip(log.replay(whole), log.replay(small), strict=True):
        assert a.count() > 0 and sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    assert small.count() < whole.count() and small.where("kind = 'ack'").count() > 0
