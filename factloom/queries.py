"""The registered queries of the fact engine and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary
from .functions.hashing import fnv1a32
from .model import hlc, millis, mutations, read, shared_dir
from .operators import agenda as agendas
from .operators import clock, lww, mapping, ordering, pending, sketches, store
from .operators import log as logs
from .operators import table as tables
from .plans import cascade, graph
from .plans.registry import Registry
from .sources.registry import conflate
from .streaming.facts import facts_at_end

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The mutation log as SQL; seq is the order of arrival.
_SEQ = "((event_id * 7919) % 10007) * 1099511627776 + event_id"
_M = f"WITH m AS (SELECT user_id AS entity, event_type AS component, value, epoch_us(ts) // 1000 AS wall, event_id AS logical, {_SEQ} AS seq, event_id FROM events)"
_ACC = f"{_M}, b AS (SELECT *, max({{'w': wall, 'l': logical}}) OVER (PARTITION BY entity, component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m), a AS (SELECT *, seen IS NULL OR {{'w': wall, 'l': logical}} > seen AS accepted FROM b)"
_LATEST = f"{_M} SELECT entity, component, arg_max(value, {{'w': wall, 'l': logical}}) AS value, max({{'w': wall, 'l': logical}}).w AS wall, max({{'w': wall, 'l': logical}}).l AS logical FROM m GROUP BY ALL"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _flat(df: DataFrame) -> DataFrame:
    return df.select("entity", "component", "value", "hlc.wall", "hlc.logical")


@query(_LATEST)
def lww_latest(spark: SparkSession, d: str) -> DataFrame:
    return _flat(lww.latest(mutations(spark, d)))


@query(f"{_ACC} SELECT event_id, accepted FROM a")
def lww_accept(spark, d):
    return lww.accepted(mutations(spark, d)).select("event_id", "accepted")


@query(f"{_ACC} SELECT component, count(*) AS n, count(*) FILTER (WHERE accepted) AS n_accepted FROM a GROUP BY component")
def lww_accept_rate(spark, d):
    return lww.accepted(mutations(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("n_accepted"))


@query(_LATEST)
def lww_merge(spark, d):
    m = mutations(spark, d)
    return _flat(lww.merge(lww.latest(m.where("event_id % 2 = 0")), lww.latest(m.where("event_id % 2 = 1"))))


@query("SELECT count(*) AS n_keys FROM (SELECT DISTINCT user_id, event_type FROM events)")
def lww_key_count(spark, d):
    return lww.latest(mutations(spark, d)).agg(F.count(F.lit(1)).alias("n_keys"))


@query(f"SELECT user_id AS entity, event_type AS component, arg_max(value, {{'d': date_trunc('day', ts), 's': -({_SEQ})}}) AS value FROM events GROUP BY ALL")
def lww_tie_first(spark, d):
    """Timestamps cut to the day: of the many equal ones the first arrival stays."""
    m = mutations(spark, d)
    day = F.floor(F.col("hlc.wall") / 86400000).cast("long") * 86400000
    return lww.latest(m.withColumn("hlc", hlc(day, F.lit(0), F.lit(1)))).select("entity", "component", "value")


@query(f"{_ACC} SELECT event_id, value, lag(value) OVER (PARTITION BY entity, component ORDER BY seq) AS previous FROM a WHERE accepted")
def lww_undo(spark, d):
    return lww.undo(mutations(spark, d)).select("event_id", "value", "previous")


@query(f"{_M} SELECT entity, component, arg_max(value, {{'w': wall, 'l': logical}}) AS value FROM m WHERE wall <= 1705276800000 GROUP BY ALL")
def lww_as_of(spark, d):
    return lww.as_of(mutations(spark, d), hlc(F.lit(1705276800000), F.lit(2**62), F.lit(1))).select("entity", "component", "value")


@query(f"{_M}, c AS (SELECT entity, component, arg_max(value, {{'w': wall, 'l': logical}}) AS value FROM m WHERE event_id % 3 = 0 GROUP BY ALL), s AS (SELECT entity, component, arg_max(value, {{'w': wall, 'l': logical}}) AS value FROM m WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT entity, component, coalesce(c.value, s.value) AS value FROM c FULL JOIN s USING (entity, component)")
def read_through(spark, d):
    m = mutations(spark, d)
    return lww.read_through(lww.latest(m.where("event_id % 3 = 0")), lww.latest(m.where("event_id % 3 <> 0"))).drop("namespace")


@query(f"{_M} SELECT 'default' AS namespace, max({{'w': wall, 'l': logical}}).w AS wall, max({{'w': wall, 'l': logical}}).l AS logical FROM m")
def latest_timestamp(spark, d):
    return lww.latest_timestamp(lww.latest(mutations(spark, d))).select("namespace", "hlc.wall", "hlc.logical")


@query(f"{_M}, w AS (SELECT *, max(wall) OVER (PARTITION BY entity ORDER BY seq) AS top FROM m) SELECT event_id, top AS wall, row_number() OVER (PARTITION BY entity, top ORDER BY seq) - 1 AS logical FROM w")
def hlc_send(spark, d):
    ticks = mutations(spark, d).select(F.col("entity").alias("node"), "event_id", "seq", F.col("hlc.wall").alias("now"))
    return clock.send(ticks).select("event_id", "wall", "logical")


@query(f"""{_M}, s AS (SELECT entity, max(wall) AS wall, 3 AS logical FROM m WHERE event_id % 2 = 0 GROUP BY entity),
    w AS (SELECT m.*, greatest(max(m.wall) OVER (PARTITION BY m.entity ORDER BY m.seq), s.wall) AS top, s.wall AS base FROM m LEFT JOIN s USING (entity) WHERE event_id % 2 = 1)
    SELECT event_id, coalesce(top, wall) AS wall, row_number() OVER (PARTITION BY entity, top ORDER BY seq) - 1 + CASE WHEN top = base THEN 4 ELSE 0 END AS logical FROM w""")
def hlc_restore(spark, d):
    m = mutations(spark, d)
    seeds = m.where("event_id % 2 = 0").groupBy(F.col("entity").alias("node")).agg(F.max("hlc.wall").alias("wall"), F.lit(3).cast("long").alias("logical"))
    ticks = m.where("event_id % 2 = 1").select(F.col("entity").alias("node"), "event_id", "seq", F.col("hlc.wall").alias("now"))
    return clock.send_after(ticks, seeds).select("event_id", "wall", "logical")


@query(f"""WITH RECURSIVE m AS (SELECT user_id AS node, epoch_us(ts) // 1000 AS now, epoch_us(ts) // 1000 + ((event_id * 31) % 7 - 3) * 1000 AS rw, event_id % 4 AS rl,
        row_number() OVER (PARTITION BY user_id ORDER BY {_SEQ}) AS k FROM events),
    f(node, k, wall, logical) AS (SELECT DISTINCT node, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM m UNION ALL
        SELECT f.node, m.k, greatest(m.now, f.wall, m.rw),
            CASE WHEN greatest(m.now, f.wall, m.rw) = f.wall AND f.wall = m.rw THEN greatest(f.logical, m.rl) + 1
                 WHEN greatest(m.now, f.wall, m.rw) = f.wall THEN f.logical + 1
                 WHEN greatest(m.now, f.wall, m.rw) = m.rw THEN m.rl + 1 ELSE 0 END
        FROM f JOIN m ON m.node = f.node AND m.k = f.k + 1)
    SELECT node, arg_max(wall, k) AS wall, arg_max(logical, k) AS logical FROM f GROUP BY node""")
def hlc_receive(spark, d):
    m = mutations(spark, d)
    shift = ((F.col("event_id") * 31) % 7 - 3) * 1000
    messages = m.select(F.col("entity").alias("node"), "seq", F.col("hlc.wall").alias("now"), (F.col("hlc.wall") + shift).alias("remote_wall"), (F.col("event_id") % 4).alias("remote_logical"))
    return clock.receive(messages)


@query(f"""WITH RECURSIVE m AS (SELECT event_id, user_id AS node, epoch_us(ts) // 1000 AS now, epoch_us(ts) // 1000 + ((event_id * 31) % 7 - 3) * 1000 AS rw, event_id % 4 AS rl,
        row_number() OVER (PARTITION BY user_id ORDER BY {_SEQ}) AS k FROM events),
    f(node, event_id, k, wall, logical) AS (SELECT DISTINCT node, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM m UNION ALL
        SELECT f.node, m.event_id, m.k, greatest(m.now, f.wall, m.rw),
            CASE WHEN greatest(m.now, f.wall, m.rw) = f.wall AND f.wall = m.rw THEN greatest(f.logical, m.rl) + 1
                 WHEN greatest(m.now, f.wall, m.rw) = f.wall THEN f.logical + 1
                 WHEN greatest(m.now, f.wall, m.rw) = m.rw THEN m.rl + 1 ELSE 0 END
        FROM f JOIN m ON m.node = f.node AND m.k = f.k + 1)
    SELECT event_id, wall, logical FROM f WHERE k > 0""")
def hlc_stamps(spark, d):
    """The stamp that each message gets when it is received."""
    m = mutations(spark, d)
    shift = ((F.col("event_id") * 31) % 7 - 3) * 1000
    messages = m.select("event_id", F.col("entity").alias("node"), "seq", F.col("hlc.wall").alias("now"), (F.col("hlc.wall") + shift).alias("remote_wall"), (F.col("event_id") % 4).alias("remote_logical"))
    return clock.received(messages).select("event_id", "wall", "logical")


@query(f"{_M} SELECT x.event_id, {{'w': x.wall, 'l': x.logical}} > {{'w': y.wall, 'l': y.logical}} AS later FROM m x JOIN m y ON y.event_id = x.event_id + 1")
def hlc_order(spark, d):
    m = mutations(spark, d).select("event_id", "hlc")
    after = m.select((F.col("event_id") - 1).alias("event_id"), F.col("hlc").alias("other"))
    return m.join(after, "event_id").select("event_id", (F.col("hlc") > F.col("other")).alias("later"))


_MAPPERS = {"counter": ("k bigint", ["k"]), "named": ("name string", ["name"]), "any": ("k string, extra string", ["k"])}


@query("SELECT event_id, component, CASE component WHEN 'counter' THEN CAST(json_extract_string(props, '$.k') AS BIGINT)::VARCHAR ELSE json_extract_string(props, '$.k') END AS k FROM events, (VALUES ('counter'), ('any')) c(component) WHERE json_extract_string(props, '$.k') IS NOT NULL")
def mapper_fanout(spark, d):
    payloads = read(spark, d, "events").select("event_id", F.col("props").alias("payload"))
    out = mapping.fan_out(payloads, {n: mapping.json_mapper(*s) for n, s in _MAPPERS.items()})
    return out.select("event_id", "component", F.get_json_object("value", "$.k").alias("k"))


_TEXTS = "CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN CAST(user_id AS VARCHAR(20)) WHEN 2 THEN '2.5' WHEN 3 THEN '\"x\"' WHEN 4 THEN props WHEN 5 THEN '[1]' ELSE '{{' END"


@query("SELECT event_id FROM events WHERE event_id % 7 <> 4 OR json_extract_string(props, '$.k') IS NULL")
def mapper_decline(spark, d):
    """Payloads of all kinds: only JSON objects with a field that a mapper needs are accepted."""
    payloads = read(spark, d, "events").select("event_id", F.expr(_TEXTS.replace("VARCHAR(20)", "STRING")).alias("payload"))
    return mapping.declined(payloads, {n: mapping.json_mapper(*s) for n, s in _MAPPERS.items()}).select("event_id")


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS temperature, 0.0::DOUBLE AS humidity, 'C' AS unit,
    CASE WHEN coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) > 40.0 THEN 'Alert' ELSE 'Ok' END AS status FROM events""")
def sensor_status(spark, d):
    """Fields that may be missing get defaults; the rule reads both and writes one of two variants."""
    rows = read(spark, d, "events").select("event_id", F.lit("SensorData").alias("source"), F.col("event_id").alias("entity"), F.col("event_id").alias("cause_id"), F.col("props"))
    fields = rows.select("*", mapping.field_or("props", "k", 0.0).alias("temperature"), mapping.field_or("props", "humidity", 0.0).alias("humidity"), mapping.field_or("props", "unit", "C").alias("unit"))
    changes = fields.select("source", "entity", "cause_id", F.lit("temperature").alias("component"), F.col("temperature").cast("string").alias("value"))
    state = fields.select("source", "entity", F.lit("humidity").alias("component"), F.col("humidity").cast("string").alias("value"))
    out = cascade.to_fixpoint(changes, sensor_rules(), state=state)
    status = out.select(F.col("cause_id").alias("event_id"), F.get_json_object("value", "$.status").alias("status"), F.get_json_object("value", "$.humidity").cast("double").alias("humidity"))
    return fields.select("event_id", "temperature", "unit").join(status, "event_id").select("event_id", "temperature", "humidity", "unit", "status")


def sensor_rules() -> Registry:
    r = Registry()
    r.source("SensorData", {"temperature": "value float, unit string", "humidity": "value float, unit string", "status": "status string"})

    @r.rule(["SensorData::temperature", "SensorData::humidity"], priority=5, writes=["SensorData::status"])
    def on_sensor_update(df, context):
        both = context.get(context.get(df, "SensorData::temperature", "t", "0.0"), "SensorData::humidity", "h", "0.0")
        status = F.when(F.col("t").cast("double") > 40.0, "Alert").otherwise("Ok")
        value = F.to_json(F.struct(status.alias("status"), F.col("h").cast("double").alias("humidity")))
        return both.withColumns({"component": F.lit("status"), "value": value}).drop("t", "h")

    return r


@query(f"SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL ELSE CASE json_type(t) WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' ELSE 'bytes' END END AS tag FROM (SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'null' ELSE {_TEXTS} END AS t FROM events)")
def json_sniff(spark, d):
    return read(spark, d, "events").withColumn("t", F.expr(_TEXTS.replace("VARCHAR(20)", "STRING"))).select("event_id", mapping.tag("t").alias("tag"))


@query(f"{_M} SELECT entity, arg_max(value, {{'w': wall, 'l': logical}}) FILTER (WHERE component = 'view') AS view_value, arg_max(value, {{'w': wall, 'l': logical}}) FILTER (WHERE component = 'purchase') AS purchase_value FROM m GROUP BY entity")
def state_pivot(spark, d):
    """Several components of one entity side by side, as a rule reads them."""
    return lww.side_by_side(mutations(spark, d), ["view", "purchase"])


@query(f"{_M}, k AS (SELECT DISTINCT entity, 'view' AS component FROM m WHERE event_id % 10 = 0) SELECT k.entity, k.component, arg_max(value, {{'w': wall, 'l': logical}}) AS value FROM k LEFT JOIN m USING (entity, component) GROUP BY ALL")
def fact_lookup(spark, d):
    """Facts by composite key; keys without a fact give null."""
    m = mutations(spark, d)
    keys = m.where("event_id % 10 = 0").select("namespace", "entity", F.lit("view").alias("component"))
    return lww.lookup(lww.latest(m), keys).select("entity", "component", "value")


def event_rules() -> Registry:
    """Rules over the event types, for the agenda queries."""
    r = Registry()
    r.source("Events", {c: "value double" for c in ("view", "click", "purchase", "signup", "error")})
    r.rule(["Events::view", "Events::click"], priority=5)(lambda df: df)
    r.rule(["Events::purchase"], priority=20)(lambda df: df)
    r.rule(["Events::view", "Events::purchase"], priority=20)(lambda df: df)
    r.rule(["Events::click"], priority=7)(lambda df: df)
    return r


_RULES = "w(component, rule_id) AS (VALUES ('view', 0), ('click', 0), ('purchase', 1), ('view', 2), ('purchase', 2), ('click', 3)), r(rule_id, priority) AS (VALUES (0, 5), (1, 20), (2, 20), (3, 7))"


def _dirty(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("dirty_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("component"))


@query(f"WITH {_RULES} SELECT event_id AS dirty_id, w.rule_id::BIGINT AS rule_id, row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, w.rule_id) AS place FROM events JOIN w ON component = event_type JOIN r ON r.rule_id = w.rule_id")
def agenda(spark, d):
    r = event_rules()
    return agendas.agenda(_dirty(spark, d), r.watchers(spark), r.rule_table(spark)).select("dirty_id", "rule_id", "place")


@query("SELECT event_id AS dirty_id FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def unwatched_ack(spark, d):
    return agendas.unwatched(_dirty(spark, d), event_rules().watchers(spark)).select("dirty_id")


@query(f"WITH {_RULES} SELECT DISTINCT w.rule_id::BIGINT AS rule_id, user_id AS entity FROM events JOIN w ON component = event_type")
def claim_coalesce(spark, d):
    r = event_rules()
    return agendas.coalesced(agendas.agenda(_dirty(spark, d), r.watchers(spark), r.rule_table(spark)))


def two_source_rules() -> Registry:
    """Two sources have a component of the same name; only one of them is watched by each rule."""
    r = Registry()
    r.source("North", {"status": "v double", "alarm": "v double"})
    r.source("South", {"status": "v double", "note": "v double"})
    r.rule(["North::status"], priority=9, writes=["North::alarm"])(lambda df: df.where("value > 50").withColumn("component", F.lit("alarm")))
    r.rule(["South::status"], priority=3, writes=["South::note"])(lambda df: df.withColumn("component", F.lit("note")))
    r.rule(["North::alarm"], priority=1, writes=["South::note"])(lambda df: df.withColumn("component", F.lit("note")))
    return r


def _two_sources(spark, d):
    e = read(spark, d, "events")
    return e.select(F.when(F.col("event_id") % 2 == 0, "North").otherwise("South").alias("source"), F.col("event_id").alias("cause_id"), F.col("user_id").alias("entity"), F.lit("status").alias("component"), "value")


@query("""SELECT event_id AS cause_id, 'South' AS source, 'note' AS component, value, 1 AS depth FROM events WHERE event_id % 2 = 1
    UNION ALL SELECT event_id, 'North', 'alarm', value, 1 FROM events WHERE event_id % 2 = 0 AND value > 50
    UNION ALL SELECT event_id, 'South', 'note', value, 2 FROM events WHERE event_id % 2 = 0 AND value > 50""")
def cascade_sources(spark, d):
    """Rules are woken by a source's component, not by another source's of the same name."""
    return cascade.unrolled(_two_sources(spark, d), two_source_rules()).select("cause_id", "source", "component", "value", "depth")


@query("SELECT event_id AS dirty_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS rule_id, 1 AS place FROM events")
def agenda_sources(spark, d):
    r = two_source_rules()
    dirty = _two_sources(spark, d).withColumnRenamed("cause_id", "dirty_id")
    return agendas.agenda(dirty, r.watchers(spark), r.rule_table(spark)).select("dirty_id", "rule_id", "place")


def failing_rules() -> Registry:
    """A rule that traps above 90, gives status 3 below 10, and floods the queue at 50 to 51."""
    r = Registry()
    r.source("S", {"reading": "v double", "checked": "v double", "many": "v double"})

    @r.rule(["S::reading"], priority=10, writes=["S::checked"])
    def check(df):
        status = F.when(F.col("value").cast("double") < 10, 3).otherwise(0)
        return df.withColumns({"component": F.lit("checked"), "status": status, "trap": F.lit(False)})

    @r.rule(["S::checked"], priority=5, writes=["S::many"])
    def spread(df):
        value = F.col("value").cast("double")
        out = df.withColumns({"trap": value > 90, "status": F.lit(0), "component": F.lit("many"), "copies": F.sequence(F.lit(1), F.when(value.between(50, 51), 9).otherwise(1))})
        return out.withColumn("copies", F.explode("copies")).drop("copies")

    @r.rule(["S::many"], writes=[])
    def end(df):
        return df.where("false")

    return r


@query("""WITH e AS (SELECT event_id AS cause_id, value, CASE WHEN value > 90 THEN 'trap' WHEN value BETWEEN 50 AND 51 THEN 'queue full' END AS reason FROM events)
    SELECT cause_id, CASE WHEN reason IS NULL THEN 'ack' ELSE 'failed' END AS kind, 'reading' AS component, 0 AS status, reason FROM e
    UNION ALL SELECT cause_id, 'put', c, CASE WHEN c = 'checked' AND value < 10 THEN 3 ELSE 0 END, NULL FROM e, (VALUES ('checked'), ('many')) v(c) WHERE reason IS NULL""")
def cascade_atomic(spark, d):
    """Outputs and acknowledgement of a change together, or neither: traps and a full queue take all back, a status is kept."""
    changes = _readings(spark, d)
    return cascade.atomic(changes, failing_rules()).select("cause_id", "kind", "component", "status", "reason")


@query("SELECT event_id AS cause_id, component, depth FROM events, (VALUES ('alert', 1), ('notification', 2)) c(component, depth) WHERE event_id = 7")
def causal_trace(spark, d):
    return cascade.trace(cascade.unrolled(_readings(spark, d), alert_rules()), F.lit(7)).select("cause_id", "component", "depth")


#: The texts that the rules of the alert example write.
ALERT, NORMAL = "ALERT: reading exceeded threshold", "OK: reading normal"


def alert_rules() -> Registry:
    """reading > 10 gives an alert, an alert gives a notification."""
    r = Registry()
    r.source("LocalExec", {"reading": "value double", "alert": "triggered boolean", "notification": "msg string"})

    @r.rule(["LocalExec::reading"], priority=10, writes=["LocalExec::alert"])
    def on_reading(df):
        return df.withColumns({"component": F.lit("alert"), "value": (F.col("value").cast("double") > 10.0).cast("string")})

    @r.rule(["LocalExec::alert"], priority=5, writes=["LocalExec::notification"])
    def on_alert(df):
        text = F.when(F.col("value") == "true", ALERT).otherwise(NORMAL)
        return df.withColumns({"component": F.lit("notification"), "value": text})

    return r


def _readings(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("cause_id"), F.col("user_id").alias("entity"), F.lit("reading").alias("component"), F.col("value").cast("string").alias("value"))


_ALERTS = f"SELECT event_id AS cause_id, c.component, CASE c.component WHEN 'alert' THEN (value > 10.0)::VARCHAR ELSE CASE WHEN value > 10.0 THEN '{ALERT}' ELSE '{NORMAL}' END END AS value, c.depth FROM events, (VALUES ('alert', 1), ('notification', 2)) c(component, depth)"


@query(_ALERTS)
def cascade_alert(spark, d):
    return cascade.unrolled(_readings(spark, d), alert_rules()).select("cause_id", "component", "value", "depth")


@query(_ALERTS)
def cascade_fixpoint(spark, d):
    """The same cascade by rounds until nothing fires."""
    return cascade.to_fixpoint(_readings(spark, d), alert_rules()).select("cause_id", "component", "value", "depth")


@query("SELECT CASE c.rule WHEN 1 THEN 'on_reading' ELSE 'on_alert' END AS rule, count(*) AS fired FROM events, (VALUES (1), (2)) c(rule) GROUP BY ALL")
def cascade_fired_count(spark, d):
    return cascade.unrolled(_readings(spark, d), alert_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("fired"))


def stock_rules() -> Registry:
    r = Registry()
    r.source("WebhookSource", {"level": "quantity bigint", "low": "sku string", "critical": "sku string"})

    @r.rule(["WebhookSource::level"], priority=20, writes=["WebhookSource::low"])
    def check_stock_level(df):
        return df.where(F.col("value") < 50).withColumn("component", F.lit("low"))

    @r.rule(["WebhookSource::low"], priority=10, writes=["WebhookSource::critical"])
    def escalate_alert(df):
        return df.where(F.col("value") < 20).withColumn("component", F.lit("critical"))

    return r


@query("SELECT p_partkey AS entity, 'low' AS component, p_size AS value FROM part WHERE p_size < 50 UNION ALL SELECT p_partkey, 'critical', p_size FROM part WHERE p_size < 20")
def cascade_inventory(spark, d):
    levels = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.lit("level").alias("component"), F.col("p_size").alias("value"))
    return cascade.unrolled(levels, stock_rules()).select("entity", "component", "value")


#: Links between users' groups: one for each error event.
_LINKS_SQL = "l AS (SELECT DISTINCT user_id % 150 AS src, (event_id * 37) % 150 AS dst FROM events WHERE event_type = 'error')"
_WALK = f"WITH RECURSIVE {_LINKS_SQL}, walk(src, dst, steps) AS (SELECT src, dst, 1 FROM l UNION SELECT w.src, l.dst, w.steps + 1 FROM walk w JOIN l ON w.dst = l.src WHERE w.steps < 12)"


def _links(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.select((F.col("user_id") % 150).alias("src"), ((F.col("event_id") * 37) % 150).alias("dst"), "event_id")


@query(f"{_WALK} SELECT src, dst, min(steps) AS steps FROM walk GROUP BY ALL")
def cascade_closure(spark, d):
    return graph.reachable(spark, _links(spark, d))


@query(f"{_WALK} SELECT src AS node, min(steps) AS length FROM walk WHERE src = dst GROUP BY src")
def graph_cycles(spark, d):
    return graph.on_cycles(spark, _links(spark, d))


@query("WITH l AS (SELECT DISTINCT user_id % 150 AS src, (event_id * 37) % 150 AS dst, event_id % 2 AS half FROM events WHERE event_type = 'error'), o AS (SELECT src, dst FROM l WHERE half = 0), n AS (SELECT src, dst FROM l WHERE half = 1) SELECT src, dst, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)")
def graph_diff(spark, d):
    halves = (_links(spark, d).where(F.col("event_id") % 2 == k).select("src", "dst").distinct() for k in (0, 1))
    return graph.difference(*halves)


@query("SELECT * FROM (VALUES ('Events', 'click', 0::BIGINT), ('Events', 'click', 3), ('Events', 'purchase', 1), ('Events', 'purchase', 2), ('Events', 'view', 0), ('Events', 'view', 2)) v(source, component, rule_id)")
def graph_watchers(spark, d):
    return event_rules().watchers(spark).drop("component_id")


_PENDING = f"{_ACC}, p AS (SELECT row_number() OVER (ORDER BY seq) AS id, event_id, component AS namespace FROM a WHERE accepted)"


def _pending(spark, d):
    return pending.pending_ids(mutations(spark, d)).select("id", "event_id", F.col("component").alias("namespace"))


@query(f"{_PENDING} SELECT id, event_id FROM p")
def pending_ids(spark, d):
    return _pending(spark, d).select("id", "event_id")


@query(f"{_PENDING} SELECT namespace, count(*) AS n FROM p GROUP BY namespace")
def pending_count(spark, d):
    return _pending(spark, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_PENDING} SELECT namespace, min(id) AS id, arg_min(event_id, id) AS event_id FROM p GROUP BY namespace")
def next_pending(spark, d):
    return pending.following(_pending(spark, d)).select("namespace", "id", "event_id")


@query(f"{_PENDING} SELECT id, event_id FROM p WHERE id % 3 <> 0")
def pending_ack(spark, d):
    p = _pending(spark, d)
    acks = p.where("id % 3 = 0").select("id").union(spark.createDataFrame([(-5,)], "id long"))
    return pending.acknowledge(p, acks).select("id", "event_id")


def _ops(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "pop").otherwise("push").alias("op"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS entity, event_type = 'purchase' AS pop, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f(entity, k, size, refused, empty) AS (SELECT DISTINCT entity, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o UNION ALL
        SELECT f.entity, o.k, CASE WHEN o.pop THEN greatest(size - 1, 0) ELSE least(size + 1, 8) END, refused + (NOT o.pop AND size >= 8)::BIGINT, empty + (o.pop AND size = 0)::BIGINT
        FROM f JOIN o ON o.entity = f.entity AND o.k = f.k + 1)
    SELECT entity, arg_max(size, k) AS size, arg_max(refused, k) AS refused, arg_max(empty, k) AS empty FROM f GROUP BY entity""")
def queue_capacity(spark, d):
    return pending.queue_fold(_ops(spark, d), 8)


@query("WITH q AS (SELECT event_id AS seq, user_id AS entity, event_type AS component FROM events), l AS (SELECT entity, component, max(seq) AS seq FROM q WHERE component = 'error' GROUP BY ALL) SELECT seq FROM q ANTI JOIN l USING (entity, component, seq)")
def queue_remove_last(spark, d):
    q = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity"), F.col("event_type").alias("component"))
    return pending.remove_last(q, q.where("component = 'error'"), ["entity", "component"]).select("seq")


@query("SELECT event_type AS source, max(event_id) AS event_id FROM events GROUP BY event_type, time_bucket(INTERVAL 1 MINUTE, ts)")
def slot_conflate(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("source"), "ts", "event_id")
    return conflate(e, "ts", ["source"], "event_id").select("source", "event_id")


@query(f"{_ACC} SELECT event_id FROM a WHERE accepted AND event_id % 4 <> 0")
def wal_replay(spark, d):
    """A log that was written and read again: what is pending after its acknowledgements."""
    m = mutations(spark, d).withColumns({"kind": F.lit("put"), "acks": F.lit(None).cast("long")})
    acks = m.where("event_id % 4 = 0").withColumns({"kind": F.lit("ack"), "acks": F.col("seq")})
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    logs.append(m, path)
    logs.append(acks, path)
    return logs.replay(spark.read.parquet(path))[1].select("event_id")


@query("""WITH RECURSIVE t AS (SELECT event_id, props AS s FROM events), f(event_id, s, k, h) AS (SELECT event_id, s, 0, 2166136261::BIGINT FROM t UNION ALL
    SELECT event_id, s, k + 1, ((xor(h, ascii(substring(s, k + 1, 1))::BIGINT))::HUGEINT * 16777619 % 4294967296)::BIGINT FROM f WHERE k < length(s)) SELECT event_id, h AS checksum FROM f WHERE k = length(s)""")
def fnv1a(spark, d):
    return read(spark, d, "events").select("event_id", fnv1a32("props").alias("checksum"))


def _kv(spark, d):
    return read(spark, d, "events").select(
        F.lit("ns").alias("namespace"), F.col("user_id").cast("string").alias("module"), F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("value"), F.col("event_id").alias("seq"),
    )


_KV = "WITH o AS (SELECT user_id::VARCHAR AS module, 'k' || (event_id % 5) AS key, event_type = 'error' AS del, value, event_id AS seq FROM events)"


@query(f"{_KV} SELECT module, key, arg_max(value, seq) AS value FROM o GROUP BY ALL HAVING NOT arg_max(del, seq)")
def kv_state(spark, d):
    return store.state(_kv(spark, d)).drop("namespace")


@query(f"{_KV} SELECT seq, existed FROM (SELECT seq, del, coalesce(lag(NOT del) OVER (PARTITION BY module, key ORDER BY seq), false) AS existed FROM o) WHERE del")
def kv_delete_flags(spark, d):
    return store.deletions(_kv(spark, d)).select("seq", "existed")


def _table(spark, d):
    return ordering.numbered(read(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id")


_T = "WITH t AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events)"


@query(f"{_T} SELECT row_id, value FROM t WHERE row_id BETWEEN 10 AND 30")
def table_range(spark, d):
    return tables.row_range(_table(spark, d), 10, 30).select("row_id", "value")


@query(f"{_T} SELECT arg_max(value, row_id) AS value FROM t")
def table_latest(spark, d):
    return tables.last_value(read(spark, d, "events"), "value", "event_id")


@query(f"{_T} SELECT row_id, event_type FROM t WHERE row_id = 42")
def table_by_row(spark, d):
    return _table(spark, d).where("row_id = 42").select("row_id", "event_type")


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def table_get(spark, d):
    return tables.by_key(read(spark, d, "events"), "user_id", "event_id").select("user_id", "value", "event_type")


@query("SELECT avg(value) AS average, count(value) AS n FROM events WHERE event_id BETWEEN 1000 AND 9000 AND event_type = 'view'")
def table_scan_avg(spark, d):
    return tables.scan_average(read(spark, d, "events"), F.col("event_id").between(1000, 9000) & (F.col("event_type") == "view"), "value")


@query("WITH o AS (SELECT event_type || '-' || (user_id % 50) AS key, event_type = 'error' AS del, value, event_id AS seq FROM events) SELECT key, arg_max(value, seq) AS value FROM o GROUP BY key HAVING NOT arg_max(del, seq)")
def ordered_map(spark, d):
    ops = read(spark, d, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), "value", F.col("event_id").alias("seq"))
    return ordering.ordered_map(ops)


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY event_type")
def bitmap_count(spark, d):
    return sketches.bits_set(sketches.bitmap(read(spark, d, "events"), "user_id", ["event_type"]), ["event_type"])


@query("WITH v AS (SELECT DISTINCT user_id AS p FROM events WHERE event_type = 'error'), c AS (SELECT DISTINCT user_id AS p FROM events WHERE event_type = 'purchase'), x AS (SELECT 'and' AS op, p FROM (SELECT p FROM v INTERSECT SELECT p FROM c) UNION ALL SELECT 'or', p FROM (SELECT p FROM v UNION SELECT p FROM c) UNION ALL SELECT 'andnot', p FROM (SELECT p FROM v EXCEPT SELECT p FROM c) UNION ALL SELECT 'xor', p FROM ((SELECT p FROM v EXCEPT SELECT p FROM c) UNION (SELECT p FROM c EXCEPT SELECT p FROM v))) SELECT op, p FROM x")
def bitmap_setops(spark, d):
    e = read(spark, d, "events")
    a, b = (e.where(F.col("event_type") == k).select(F.col("user_id").alias("p")).distinct() for k in ("error", "purchase"))
    parts = [sketches.combine(a, b, op).select(F.lit(op).alias("op"), "p") for op in ("and", "or", "xor", "andnot")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH a AS (SELECT DISTINCT user_id AS p, user_id // 32768 AS bucket FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id AS p, user_id // 32768 AS bucket FROM events WHERE event_type = 'purchase'),
    k AS (SELECT DISTINCT bucket FROM a INTERSECT SELECT DISTINCT bucket FROM b), x AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.bucket, b.bucket) AS bucket, a.p IS NOT NULL AS ina, b.p IS NOT NULL AS inb FROM a FULL JOIN b USING (p)),
    c AS (SELECT bucket, count(*) FILTER (WHERE ina AND inb) AS n_and, count(*) AS n_or, count(*) FILTER (WHERE ina <> inb) AS n_xor, count(*) FILTER (WHERE ina AND NOT inb) AS n_andnot, 32768 - count(*) FILTER (WHERE ina) AS n_not,
        count(*) FILTER (WHERE ina OR p % 32768 BETWEEN 3 AND 20) + 18 - count(*) FILTER (WHERE p % 32768 BETWEEN 3 AND 20) AS n_set, count(*) FILTER (WHERE ina AND p % 32768 NOT BETWEEN 3 AND 20) AS n_cleared, coalesce(bool_or(ina AND p % 32768 = 7), false) AS bit_7 FROM x GROUP BY bucket)
    SELECT bucket + 1 AS bucket, n_and, n_or, n_xor, n_andnot, n_not, n_set, n_cleared, bit_7 FROM c WHERE bucket IN (SELECT bucket FROM k)""")
def bitmap_bytes(spark, d):
    """Operations on the bytes of two bitmaps: and, or, xor, and-not, not, ranges set and cleared, one bit."""
    e = read(spark, d, "events")
    a, b = (sketches.bitmap(e.where(F.col("event_type") == k).withColumn("p", F.col("user_id") + 1), "p").withColumnRenamed("bits", name) for k, name in (("error", "a"), ("purchase", "b")))
    x, y, count = F.col("a"), F.col("b"), F.bitmap_count
    return a.join(b, "bucket").select(
        "bucket", *(count(sketches.bit_op(x, y, how)).alias(f"n_{how}") for how in ("and", "or", "xor", "andnot")), count(sketches.bit_not(x)).alias("n_not"),
        count(sketches.bit_range(x, F.lit(3), F.lit(20), True)).alias("n_set"), count(sketches.bit_range(x, F.lit(3), F.lit(20), False)).alias("n_cleared"), sketches.bit_get(x, F.lit(7)).alias("bit_7"),
    )


@query("SELECT event_type, count(DISTINCT user_id // 32768)::BIGINT * 32768 - count(DISTINCT user_id)::BIGINT AS n FROM events GROUP BY event_type")
def bitmap_clear(spark, d):
    e = read(spark, d, "events").withColumn("p", F.col("user_id") + 1)
    return sketches.bits_clear(sketches.bitmap(e, "p", ["event_type"]), ["event_type"])


@query("SELECT event_id, lower(printf('%08X', event_id % 4294967296)) AS big, event_id % 4294967296 AS back, CAST(event_id % 3 = 0 AS BOOLEAN) AS flag FROM events")
def binary_codec(spark, d):
    """Integers to bytes and back; literals of text."""
    e = read(spark, d, "events")
    little = binary.little_endian(F.col("event_id"), 4)
    flag = binary.literal(F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), "bool")
    return e.select("event_id", F.lower(F.hex(binary.big_endian(F.col("event_id"), 4))).alias("big"), binary.from_little_endian(little, 4).alias("back"), flag.alias("flag"))


@query(f"{_KV}, s AS (SELECT module, key, arg_max(value, seq) AS value FROM o GROUP BY ALL HAVING NOT arg_max(del, seq)), r AS (SELECT DISTINCT module, key FROM o UNION SELECT DISTINCT module, 'none' FROM o) SELECT module, key, CASE WHEN s.module IS NULL THEN 1 ELSE 0 END AS status, s.value FROM r LEFT JOIN s USING (module, key)")
def kv_get(spark, d):
    """Status 0 with the value, or 1 for what is missing."""
    ops = _kv(spark, d)
    asked = ops.select("namespace", "module", "key").union(ops.select("namespace", "module", F.lit("none"))).distinct()
    return store.get(store.state(ops), asked).select("module", "key", "status", "value")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)")
def bloom_semi(spark, d):
    e = read(spark, d, "events")
    return sketches.bloom_semi_join(e, e.where("event_type = 'signup' AND value > 90").select("user_id"), "user_id").select("event_id")


@query("SELECT conv_id AS namespace, count(*) AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def namespace_scope(spark, d):
    """Namespaces keep their facts apart: the last role of each, and how many were put."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("namespace"), F.lit(0).alias("entity"), F.lit("role").alias("component"), F.col("role").alias("value"), hlc("turn", F.lit(0), F.lit(1)).alias("hlc"), F.col("turn").alias("seq"))
    facts = lww.latest(c).select("namespace", F.col("value").alias("last_role"))
    return c.groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).join(facts, "namespace")


@query(_LATEST)
def stream_lww_equals_batch(spark, d):
    """The log read as a stream to its end: the facts are those of the batch."""
    events = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    arrival = (F.col("event_id") * 7919 % 10007) * 1099511627776 + F.col("event_id")
    log = events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("component"), "value", hlc(millis(), F.col("event_id"), F.lit(1)).alias("hlc"), arrival.alias("seq"))
    where = f"{shared_dir(spark)}/facts_{uuid.uuid4().hex}"
    return _flat(facts_at_end(log, ["entity", "component"], where))


@query("SELECT DISTINCT unnest(range(greatest(event_id % 300 - 20, 0), least(event_id % 300 - 20 + 3, 255) + 1)) AS p FROM events WHERE event_type = 'error' AND event_id % 300 - 20 <= 255")
def bitmap_ranges(spark, d):
    e = read(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") % 300 - 20).alias("a"))
    return sketches.set_ranges(e.withColumn("b", F.col("a") + 3), "a", "b", 256)


@query("SELECT user_id::VARCHAR AS entity, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def dynamic_entities(spark, d):
    """One entity for each key of the payload, rather than one for the source."""
    payloads = read(spark, d, "events").select("user_id", F.col("props").alias("payload"))
    mapped = mapping.fan_out(payloads, {"counter": mapping.json_mapper("k bigint", ["k"])})
    return mapping.entities(mapped, 0, F.col("user_id")).groupBy("entity", F.get_json_object("value", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
