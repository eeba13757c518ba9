"""Queries on rules, alerts and run comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import MATCHER_TYPE, Matcher, label, label_key
from pulsegrid.operators import alerts as A
from pulsegrid.operators import compare as C
from pulsegrid.operators import rules as R
from pulsegrid.plans.points import _us, rounded, text, us
from pulsegrid.plans.vectors import COUNTERS, GRID, START, _instant, engine, shown
from pulsegrid.sources import config, events
from pulsegrid.sources.shared import new_path

RULE = R.Rule(
    "high-purchase", "HighPurchase", for_="24h", interval="12h", severity="critical", labels={"team": "sales"},
    annotations={"summary": "{{ .Value }} on {{ .Labels.agent_id }}, {{.Labels.none}}!", "broken": "{{ .Oops }}"}, receivers=("log", "mail"),
)
MERGED = R.Rule("any-purchase", "AnyPurchase", labels={"shard": "all", "agent_id": "all"}, tenant="ops")
RESEND, BY, AT = "36h", ("team", "shard"), 20
INHIBIT = [
    A.InhibitRule((Matcher("shard", "=", "s1"),), (Matcher("shard", "=~", "s[02]"),), ("team", "zone")),
    A.InhibitRule((Matcher("agent_id", "=", "agent-1"),), (Matcher("alertname", "=", "HighPurchase"),), ("shard",)),
]
GROUPING = A.Grouping(by=BY, wait="6h", interval="24h", repeat="96h", default_receivers=("log",))


def _breaching(spark, sf_dir):
    return engine(spark, sf_dir).metric("purchase").instant() > 60.0


def _results(spark, sf_dir) -> DataFrame:
    return R.evaluate(RULE, _breaching(spark, sf_dir))


def _states(spark, sf_dir) -> DataFrame:
    return R.alert_states(_results(spark, sf_dir), RULE, GRID)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, so that what makes it runs once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _states_and_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    results = _stored(_results(spark, sf_dir), "results")
    states = _stored(R.alert_states(results, RULE, GRID), "states")
    return states, R.alert_events(results, states, RULE, GRID, RESEND).withColumn("at", GRID.time(F.col("i")))


def _events(spark, sf_dir) -> DataFrame:
    return _states_and_events(spark, sf_dir)[1]


def backtest(spark, sf_dir):
    return shown(_breaching(spark, sf_dir))


def alert_labels(spark, sf_dir):
    return _results(spark, sf_dir).select("i", "key", text().alias("labels"))


def fingerprint(spark, sf_dir):
    return _results(spark, sf_dir).select("i", "key", "fingerprint")


def collapse_duplicates(spark, sf_dir):
    return R.evaluate(MERGED, _breaching(spark, sf_dir)).select("i", "key", rounded(), text().alias("labels"))


def alert_states(spark, sf_dir):
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return _states(spark, sf_dir).select("fingerprint", rounded(), "first_i", "last_i", none("fired_i"), none("resolved_i"))


def alert_events(spark, sf_dir):
    return _events(spark, sf_dir).select("fingerprint", "i", "status", rounded(), us("starts_at").alias("starts"), F.coalesce(us("ends_at"), F.lit(0)).alias("ends"))


def resolve_removed(spark, sf_dir):
    states = _states(spark, sf_dir)
    removed = states.select("rule_id").distinct()
    return R.resolve_removed(states, removed, AT, GRID).select("fingerprint", "i", "status", rounded(), us("ends_at").alias("ends"))


def render_annotations(spark, sf_dir):
    out = R.build_alerts(_events(spark, sf_dir), RULE)
    big = R.render('{{ .Value }}, {{ printf "%.0f" .Value }}', F.round(F.col("value") * 100_000), F.col("labels"))
    return out.select("fingerprint", "i", "status", F.col("annotations")["summary"].alias("summary"), F.col("annotations")["broken"].alias("broken"), big.alias("big"))


def active_alerts(spark, sf_dir):
    return R.active_alerts(_states(spark, sf_dir), AT, GRID).select("fingerprint", "state")


def alert_listing(spark, sf_dir):
    rows = R.alert_listing(R.active_alerts(_states(spark, sf_dir), AT, GRID), "firing")
    return rows.select("fingerprint", "state", label(F.col("labels"), "agent_id").alias("agent_id"))


def _silences(spark, sf_dir) -> DataFrame:
    """One silence for each supplier: two days from a day that its number gives."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey") % 25
    m = lambda name, op, v: F.struct(F.lit(name).alias("name"), F.lit(op).alias("op"), v.alias("value"))
    matchers = F.when(k % 5 == 4, F.array().cast(MATCHER_TYPE)).otherwise(F.array(m("agent_id", "=~", F.concat(F.lit("agent-["), k % 4, F.lit("-"), k % 4 + 2, F.lit("]"))), m("shard", "!=", F.concat(F.lit("s"), k % 3))))
    start = F.timestamp_micros(F.lit(_us(START)) + k * 86_400_000_000)
    return n.select(F.concat(F.lit("silence-"), F.col("s_suppkey")).alias("id"), F.when(k % 2 == 0, "").otherwise("sales").alias("tenant"), matchers.alias("matchers"), start.alias("starts_at"), (F.when(k % 6 != 5, 2 * 86_400)).alias("duration"), F.lit(None).cast("timestamp").alias("ends_at"))


def _good_silences(spark, sf_dir):
    return A.silence_validate(_silences(spark, sf_dir)).filter("error IS NULL")


def silence_validate(spark, sf_dir):
    return A.silence_validate(_silences(spark, sf_dir)).select("id", F.coalesce(us("ends_at"), F.lit(0)).alias("ends"), "error")


def silence_active(spark, sf_dir):
    return A.silence_active(_good_silences(spark, sf_dir), GRID.time(F.lit(AT))).select("id")


def silence_gc(spark, sf_dir):
    return A.silence_gc(_good_silences(spark, sf_dir), GRID.time(F.lit(AT))).select("id")


def silence_listing(spark, sf_dir):
    return A.silence_listing(_good_silences(spark, sf_dir), GRID.time(F.lit(AT)), expired=True).select("id", "status")


def _firing_events(spark, sf_dir):
    return _events(spark, sf_dir).filter("status = 'firing'")


def silence_mutes(spark, sf_dir):
    return A.silence_mutes(_stored(_firing_events(spark, sf_dir), "events"), _good_silences(spark, sf_dir)).select("fingerprint", "i", "silenced")


def delivery_silence(spark, sf_dir):
    members = _events(spark, sf_dir).withColumn("sent_at", F.timestamp_micros(F.unix_micros("at") + 86_400_000_000))
    return A.delivery_silence(_stored(members, "members"), _good_silences(spark, sf_dir)).select("fingerprint", "i", "status")


def _inhibited(spark, sf_dir):
    states, found = _states_and_events(spark, sf_dir)
    firing = states.filter("fired_i IS NOT NULL").select("fingerprint", "labels", GRID.time(F.col("fired_i")).alias("fires_at"), GRID.time(F.col("resolved_i")).alias("resolves_at"))
    return A.inhibit(_stored(found, "events"), firing, INHIBIT)


def inhibit(spark, sf_dir):
    return _inhibited(spark, sf_dir).select("fingerprint", "i", "status", "inhibited")


def _forwarded(spark, sf_dir):
    muted = A.silence_mutes(_stored(_inhibited(spark, sf_dir), "inhibited"), _good_silences(spark, sf_dir))
    return A.forwarded_resolutions(muted.withColumn("muted", (F.col("silenced") | F.col("inhibited")) & (F.col("status") == "firing")))


def forwarded_resolutions(spark, sf_dir):
    return _forwarded(spark, sf_dir).select("fingerprint", "i", "status")


def _routed(spark, sf_dir):
    return A.route_receivers(R.build_alerts(_events(spark, sf_dir), RULE), GROUPING)


def route_receivers(spark, sf_dir):
    return _routed(spark, sf_dir).select("fingerprint", "i", "status", "receiver")


def group_key(spark, sf_dir):
    rows = _routed(spark, sf_dir)
    return rows.select("fingerprint", "i", "receiver", A.group_key(F.col("receiver"), F.col("labels"), BY).alias("group"), label_key(A.group_labels(F.col("labels"), BY)).alias("labels"))


def _members(spark, sf_dir):
    """The alerts of each group and time as arrays."""
    rows = _routed(spark, sf_dir).withColumns({"group": A.group_key(F.col("receiver"), F.col("labels"), BY), "sent_at": F.col("at")})
    return A.notifications(rows.select("group", "receiver", "sent_at", "fingerprint", "status"), rows.select("fingerprint", "labels").dropDuplicates(["fingerprint"]))


def group_content_hash(spark, sf_dir):
    pairs = F.transform("alerts", lambda a: F.struct(a["fingerprint"].alias("fingerprint"), a["status"].alias("status")))
    return _members(spark, sf_dir).select("group", us("sent_at").alias("us"), F.upper(A.group_content_hash(pairs)).alias("content"))


def group_status_counts(spark, sf_dir):
    return _members(spark, sf_dir).select("group", us("sent_at").alias("us"), A.group_status_counts(F.col("alerts")).alias("s")).select("group", "us", "s.status", "s.firing", "s.resolved")


def group_summary(spark, sf_dir):
    return _members(spark, sf_dir).select("group", us("sent_at").alias("us"), F.array_join(A.group_summary(F.col("alerts")), "\n").alias("summary"))


def notification_payload(spark, sf_dir):
    rows = _members(spark, sf_dir)
    labels = F.create_map(F.lit("team"), F.lit("sales"))
    alerts = F.transform("alerts", lambda a: F.struct(a["fingerprint"].alias("fingerprint"), a["status"].alias("status")))
    return rows.select("group", us("sent_at").alias("us"), A.notification_payload(F.col("group"), F.col("receiver"), labels, alerts).alias("body"))


def group_notifications(spark, sf_dir):
    """Every sending of the forwarded alerts, folded with the groups' timers."""
    routed = A.route_receivers(R.build_alerts(_forwarded(spark, sf_dir), RULE), GROUPING)
    out = A.group_notifications(routed, GROUPING, GRID.start + GRID.last * GRID.step)
    return out.select("group", "receiver", us("sent_at").alias("us"), "fingerprint", "status")


def agents_list(spark, sf_dir):
    return A.agents_list(events.samples(spark, sf_dir), GRID.time(F.lit(GRID.last)), "120h", "3h").select("agent_id", us("last_seen").alias("us"), rounded("uptime", "uptime"), "tenant", "status")


def _measurements(spark, sf_dir):
    """Prices of line items by mode and flag; returned ones are the first run, others the second."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.concat("l_linestatus", F.lit("/"), (F.col("l_orderkey") % 400).cast("string")).alias("name"), F.when(F.col("l_linenumber") < 4, "price").otherwise("quantity").alias("unit"),
        F.when(F.col("l_linenumber") < 4, F.col("l_extendedprice").cast("double")).otherwise(F.col("l_quantity").cast("double")).alias("value"),
        F.when(F.col("l_returnflag") == "R", "old").otherwise("new").alias("run"),
    )


def median_spread(spark, sf_dir):
    return C.median_spread(_measurements(spark, sf_dir), ["name", "unit", "run"]).select("name", "unit", "run", "n", rounded("median", "median"), rounded("spread", "spread"))


def rank_pooled(spark, sf_dir):
    rows = C.rank_pooled(_measurements(spark, sf_dir))
    return rows.groupBy("name", "unit", "run").agg(F.sum("rank").alias("ranks"), F.sum(F.col("tied").cast("double") ** 2 - 1).alias("ties"))


def mann_whitney(spark, sf_dir):
    return C.mann_whitney(_measurements(spark, sf_dir), "old", "new").select("name", "unit", "n1", "n2", "u", "ties", rounded("p", "p"), "method")


def mann_whitney_u(spark, sf_dir):
    """The test without its p-value."""
    return C.mann_whitney(_measurements(spark, sf_dir), "old", "new").select("name", "unit", "n1", "n2", "u", "ties", "method")


def compare_deltas(spark, sf_dir):
    """The comparison without its p-value."""
    out = C.compare_runs(_measurements(spark, sf_dir), "old", "new")
    return out.select("name", "unit", "side", "old_n", "new_n", rounded("old_median", "old_median"), rounded("new_median", "new_median"), rounded("delta", "delta"))


def _config_file(df: DataFrame, field: str, item, **others) -> str:
    """A configuration file whose list `field` has an item for each row of a table, in order of `place`."""
    path = new_path(df.sparkSession, "config")
    items = df.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item"))))["item"].alias(field))
    items.select(F.to_json(F.struct(field, *(c.alias(k) for k, c in others.items()))).alias("value")).coalesce(1).write.text(path)
    return path


def load_rules(spark, sf_dir):
    """Rules from a file with one for each nation."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    rule = F.struct(
        F.concat(F.lit("rule-"), key).alias("id"), F.col("n_name").alias("name"), F.lit("5m").alias("for"), F.element_at(F.array(*map(F.lit, R.SEVERITIES)), (F.col("n_regionkey") % 3 + 1).cast("int")).alias("severity"),
        F.struct(F.col("r_name").alias("segment")).alias("labels"), F.concat(F.lit("purchase > "), key).alias("expression"), (key % 2 == 0).alias("enabled"),
    )
    loaded = config.load_rules(spark, _config_file(rows.withColumn("place", key), "rules", rule))
    out = [(x.rule.id, x.rule.name, f"{R.micros(x.rule.for_) // 1_000_000}s", x.rule.severity, ",".join(f"{k}={v}" for k, v in x.rule.labels.items()), x.expression, x.enabled) for x in loaded]
    return spark.createDataFrame(out, "id string, name string, wait string, severity string, labels string, expression string, enabled boolean")


def load_routing(spark, sf_dir):
    """Receivers from a file with one for each nation; the first region's are defaults and inhibit."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("place", F.col("n_nationkey"))
    first = F.array_sort(F.collect_list(F.when(F.col("n_regionkey") == 0, F.struct("place", "n_name"))))["n_name"]
    matcher = lambda name: F.array(F.struct(F.lit("nation").alias("name"), F.lit("=").alias("op"), name.alias("value")))
    names = rows.agg(first.alias("names")).head()["names"]
    names = F.array(*(F.lit(n) for n in names))
    inhibit = F.transform(names, lambda n: F.struct(matcher(n).alias("source_matchers"), matcher(n).alias("target_matchers")))
    loaded = config.load_routing(spark, _config_file(rows, "receivers", F.struct(F.col("n_name").alias("name")), default_receivers=names, inhibit_rules=inhibit))
    inhibits = {r.source[0].value: f"nation={r.target[0].value}" for r in loaded.inhibit}
    out = [(name, name in loaded.grouping.default_receivers, n, inhibits.get(name)) for n, name in enumerate(loaded.receivers)]
    return spark.createDataFrame(out, "receiver string, is_default boolean, place long, inhibits string")


def compare_runs(spark, sf_dir):
    out = C.compare_runs(_measurements(spark, sf_dir), "old", "new")
    return out.select("name", "unit", "side", rounded("delta", "delta"), rounded("p", "p"), "method", "significant")


_F = lambda x: f"repeat(chr(0), 7) || chr(CAST(strlen({x}) AS INTEGER)) || {x}"
_FP = "left(sha256(" + " || ".join(_F(x) for x in ("'high-purchase'", "'agent_id'", "agent_id", "'alertname'", "'HighPurchase'", "'severity'", "'critical'", "'shard'", "shard", "'team'", "'sales'")) + "), 16)"
_LABELS = "'agent_id=' || agent_id || ',alertname=HighPurchase,severity=critical,shard=' || shard || ',team=sales'"
_BASE = f"""WITH {COUNTERS}, p AS ({_instant('purchase')}), res AS (
    SELECT i, t, key, value, regexp_extract(key, 'agent_id=([^,]*)', 1) AS agent_id, regexp_extract(key, 'shard=([^,]*)', 1) AS shard FROM p WHERE value > 60
), r AS (SELECT *, {_FP} AS fingerprint, {_LABELS} AS labels FROM res), numbered_r AS (
    SELECT *, i - row_number() OVER (PARTITION BY fingerprint ORDER BY i) AS run FROM r
), runs AS (
    SELECT fingerprint, min(i) AS first_i, max(i) AS last_i, arg_max(value, i) AS value, any_value(agent_id) AS agent_id, any_value(shard) AS shard, any_value(labels) AS labels FROM numbered_r GROUP BY fingerprint, run
), st AS (
    SELECT *, CASE WHEN last_i >= first_i + 2 THEN first_i + 2 END AS fired_i, CASE WHEN last_i >= first_i + 2 AND last_i < {GRID.last} THEN last_i + 1 END AS resolved_i FROM runs
), ev AS (
    SELECT s.fingerprint, s.first_i, e.i, 'firing' AS status, r.value, s.agent_id, s.shard, s.labels, CAST(NULL AS BIGINT) AS ends_i
    FROM (SELECT *, unnest(range(fired_i, last_i + 1, 3)) AS at_i FROM st WHERE fired_i IS NOT NULL) s, LATERAL (SELECT s.at_i AS i) e JOIN r ON r.fingerprint = s.fingerprint AND r.i = e.i
    UNION ALL SELECT fingerprint, first_i, resolved_i, 'resolved', value, agent_id, shard, labels, resolved_i FROM st WHERE resolved_i IS NOT NULL
), events_ AS (SELECT *, {GRID.start} + i * {GRID.step} AS us FROM ev), sil AS (
    SELECT 'silence-' || s_suppkey AS id, CASE WHEN k % 2 = 0 THEN '' ELSE 'sales' END AS tenant, k, {_us(START)} + k * 86400000000 AS starts,
           {_us(START)} + k * 86400000000 + CASE WHEN k % 6 <> 5 THEN 2 * 86400000000 END AS ends FROM (SELECT *, s_suppkey % 25 AS k FROM supplier)
), good AS (SELECT * FROM sil WHERE ends IS NOT NULL AND k % 5 <> 4)"""
_MUTE = "EXISTS (SELECT 1 FROM good g WHERE g.tenant = '' AND g.starts <= {0} AND {0} < g.ends AND regexp_full_match(agent_id, 'agent-[' || (k % 4) || '-' || (k % 4 + 2) || ']') AND shard <> 's' || (k % 3))"
_FIRES = f"{GRID.start} + s.fired_i * {GRID.step} <= e.us AND (s.resolved_i IS NULL OR e.us < {GRID.start} + s.resolved_i * {GRID.step})"
_INHIBITED = f"""EXISTS (SELECT 1 FROM st s WHERE s.fired_i IS NOT NULL AND s.fingerprint <> e.fingerprint AND {_FIRES}
    AND ((s.shard = 's1' AND e.shard IN ('s0', 's2')) OR (s.agent_id = 'agent-1' AND s.shard = e.shard)))"""
_ROUTED = "routed AS (SELECT e.*, receiver, receiver || '|shard=' || shard || ',team=sales' AS grp FROM events_ e, (VALUES ('log'), ('mail')) v(receiver))"
_FORWARDED = f"""judged AS (SELECT e.*, status = 'firing' AND ({_MUTE.format('us')} OR {_INHIBITED}) AS muted FROM events_ e), counted AS (
    SELECT *, coalesce(max(CASE WHEN status = 'firing' AND NOT muted THEN i END) OVER w, -1) AS sent, coalesce(max(CASE WHEN status = 'resolved' THEN i END) OVER w, -1) AS ended
    FROM judged WINDOW w AS (PARTITION BY fingerprint ORDER BY i, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), forwarded AS (SELECT * FROM counted WHERE CASE WHEN status = 'firing' THEN NOT muted ELSE sent > ended END)"""
_WAIT, _INTERVAL, _REPEAT = GROUPING.timers()


def group_sql(until: str) -> str:
    """Sendings before the time `until`: a row of the walk takes a group's next event in, or sends what is due before it."""
    return f"""{_BASE.replace("WITH", "WITH RECURSIVE", 1)}, {_FORWARDED}, sides AS (
    SELECT receiver || '|shard=' || shard || ',team=sales' AS grp, receiver, us, fingerprint, status FROM forwarded, (VALUES ('log'), ('mail')) v(receiver)
), steps AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY us, fingerprint, status) AS n FROM sides
    UNION ALL SELECT grp, any_value(receiver), {until}, NULL, NULL, count(*) + 1 FROM sides GROUP BY grp
), walk AS (
    SELECT grp, receiver, CAST(1 AS BIGINT) AS n, CAST([] AS STRUCT(f VARCHAR, s VARCHAR)[]) AS members, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS last,
           CAST(NULL AS STRUCT(f VARCHAR, s VARCHAR)[]) AS sent, CAST(NULL AS BIGINT) AS sent_at FROM steps WHERE n = 1
    UNION ALL
    SELECT grp, receiver, CASE WHEN flush THEN n ELSE n + 1 END, CASE WHEN flush AND NOT same THEN still WHEN flush THEN members ELSE taken END,
           CASE WHEN flush AND same THEN last + {_REPEAT} WHEN flush AND len(still) = 0 THEN NULL WHEN flush THEN due + {_REPEAT}
                WHEN due IS NULL THEN us + {_WAIT} WHEN changed AND last IS NOT NULL THEN greatest(us, last + {_INTERVAL}) ELSE due END,
           CASE WHEN flush AND NOT same THEN CASE WHEN len(still) > 0 THEN due END ELSE last END,
           CASE WHEN flush AND NOT same THEN members WHEN last IS NULL THEN NULL ELSE sent END, CASE WHEN flush AND NOT same THEN due END
    FROM (
        SELECT w.*, e.us, e.fingerprint, coalesce(w.due < e.us, false) AS flush, coalesce(w.members = w.sent AND w.due < w.last + {_REPEAT}, false) AS same,
               list_filter(w.members, lambda m: m.s <> 'resolved') AS still, NOT list_contains(w.members, {{'f': e.fingerprint, 's': e.status}}) AS changed,
               list_sort(list_append(list_filter(w.members, lambda m: m.f <> e.fingerprint), {{'f': e.fingerprint, 's': e.status}})) AS taken
        FROM walk w JOIN steps e ON e.grp = w.grp AND e.n = w.n
    ) WHERE flush OR fingerprint IS NOT NULL
) SELECT grp AS "group", receiver, sent_at AS us, m.f AS fingerprint, m.s AS status FROM (SELECT grp, receiver, sent_at, unnest(sent) AS m FROM walk WHERE sent_at IS NOT NULL)"""


_AT_US = f"{GRID.start + AT * GRID.step}"
_MEASURED = """WITH m AS (
    SELECT l_linestatus || '/' || (l_orderkey % 400) AS name, CASE WHEN l_linenumber < 4 THEN 'price' ELSE 'quantity' END AS unit,
           CAST(CASE WHEN l_linenumber < 4 THEN l_extendedprice ELSE l_quantity END AS DOUBLE) AS value, CASE WHEN l_returnflag = 'R' THEN 'old' ELSE 'new' END AS run FROM lineitem
)"""
_RANKED = f"""{_MEASURED}, q AS (SELECT *, count(*) OVER (PARTITION BY name, unit, value) AS tied, rank() OVER (PARTITION BY name, unit ORDER BY value) AS low FROM m)"""
_TESTED = f"""sides AS (
    SELECT name, unit, count(*) FILTER (WHERE run = 'old') AS n1, count(*) FILTER (WHERE run = 'new') AS n2, coalesce(sum(low + (tied - 1) / 2.0) FILTER (WHERE run = 'old'), 0) AS r1, CAST(sum(tied * tied - 1) AS DOUBLE) AS ties FROM q GROUP BY name, unit
), tested AS (
    SELECT name, unit, n1, n2, CAST(least(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) AS DOUBLE) AS u, ties,
           CASE WHEN n1 = 0 OR n2 = 0 THEN 'none' WHEN ties = 0 AND greatest(n1, n2) <= {C.EXACT_LIMIT} THEN 'exact' ELSE 'normal' END AS method FROM sides
)"""
#: The exact case counts orders by U, one more old value in each step: the greatest old value is above c of the b new ones, and
#: the others are ordered with those c. The normal case is the power series of the error function.
_P_VALUES = f"""{_RANKED.replace("WITH", "WITH RECURSIVE", 1)}, {_TESTED}, orders AS (
    SELECT 0 AS i, list_transform(range({C.EXACT_LIMIT + 1}), lambda b: list_transform(range({C.EXACT_LIMIT**2 + 1}), lambda k: CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0 END)) AS ways
    UNION ALL
    SELECT i + 1, list_transform(range({C.EXACT_LIMIT + 1}), lambda b: list_transform(range({C.EXACT_LIMIT**2 + 1}), lambda k: list_sum(list_transform(range(b + 1), lambda c: CASE WHEN k >= c THEN ways[c + 1][k - c + 1] ELSE 0 END))))
    FROM orders WHERE i < {C.EXACT_LIMIT}
), spread AS (
    SELECT *, n1 * n2 / 12.0 * (n1 + n2 + 1 - CASE WHEN ties = 0 THEN 0 ELSE ties / ((n1 + n2) * (n1 + n2 - 1)) END) AS variance FROM tested
), scored AS (
    SELECT *, CASE WHEN method = 'normal' AND variance > 0 THEN greatest(0, (n1 * n2 / 2.0 - 0.5 - u) / sqrt(variance) / sqrt(2)) END AS x FROM spread
), valued AS (
    SELECT name, unit, n1, n2, u, ties, method, CASE WHEN method = 'exact' THEN least(1, 2 * list_sum(ways[n2 + 1][1:CAST(floor(u) AS BIGINT) + 1]) / list_sum(ways[n2 + 1])) WHEN coalesce(x, 0) = 0 THEN 1 WHEN x > 6 THEN 0
        ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(200), lambda n: exp(-x * x + (2 * n + 1) * ln(x) + 2 * n * ln(2) - lgamma(2 * n + 2) + lgamma(n + 1)))) END AS p
    FROM scored LEFT JOIN orders ON method = 'exact' AND i = n1
)"""

QUERIES = {
    f.__name__: f
    for f in (
        backtest, alert_labels, fingerprint, collapse_duplicates, alert_states, alert_events, resolve_removed, render_annotations, active_alerts, alert_listing,
        silence_validate, silence_active, silence_gc, silence_listing, silence_mutes, delivery_silence, inhibit, forwarded_resolutions,
        route_receivers, group_key, group_content_hash, group_status_counts, group_summary, notification_payload, group_notifications, agents_list,
        median_spread, rank_pooled, mann_whitney, mann_whitney_u, compare_runs, compare_deltas, load_rules, load_routing,
    )
}

ORACLE_SQL = {
    "backtest": f"{_BASE} SELECT t, key AS labels, round(value, 6) AS value FROM r",
    "alert_labels": f"{_BASE} SELECT i, key, labels FROM r",
    "fingerprint": f"{_BASE} SELECT i, key, fingerprint FROM r",
    "collapse_duplicates": f"{_BASE} SELECT i, min(key) AS key, round(arg_min(value, key), 6) AS value, 'agent_id=all,alertname=AnyPurchase,severity=warning,shard=all,tenant=ops' AS labels FROM r GROUP BY i",
    "alert_states": f"{_BASE} SELECT fingerprint, round(value, 6) AS value, first_i, last_i, coalesce(fired_i, -1) AS fired_i, coalesce(resolved_i, -1) AS resolved_i FROM st",
    "alert_events": f"{_BASE} SELECT fingerprint, i, status, round(value, 6) AS value, {GRID.start} + first_i * {GRID.step} AS starts, coalesce({GRID.start} + ends_i * {GRID.step}, 0) AS ends FROM ev",
    "resolve_removed": f"{_BASE} SELECT fingerprint, CAST({AT} AS BIGINT) AS i, 'resolved' AS status, round(value, 6) AS value, CAST({_AT_US} AS BIGINT) AS ends FROM st WHERE fired_i <= {AT} AND last_i >= {AT}",
    "render_annotations": f"""{_BASE} SELECT fingerprint, i, status, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' on ' || agent_id || ', !' AS summary, '{{{{ .Oops }}}}' AS broken,
        CASE WHEN length(d) <= 6 THEN d ELSE d[1] || CASE WHEN rtrim(d[2:], '0') = '' THEN '' ELSE '.' || rtrim(d[2:], '0') END || 'e+0' || (length(d) - 1) END || ', ' || d AS big
        FROM (SELECT *, CAST(CAST(round(value * 100000) AS BIGINT) AS VARCHAR) AS d FROM ev)""",
    "active_alerts": f"{_BASE} SELECT fingerprint, CASE WHEN fired_i <= {AT} THEN 'firing' ELSE 'pending' END AS state FROM st WHERE first_i <= {AT} AND last_i >= {AT}",
    "alert_listing": f"{_BASE} SELECT fingerprint, 'firing' AS state, agent_id FROM st WHERE fired_i <= {AT} AND last_i >= {AT}",
    "silence_validate": f"""{_BASE} SELECT id, coalesce(ends, 0) AS ends, CASE WHEN k % 5 = 4 THEN 'silence needs at least one matcher'
        WHEN ends IS NULL THEN 'silence ends_at must be after starts_at' END AS error FROM sil""",
    "silence_active": f"{_BASE} SELECT id FROM good WHERE starts <= {_AT_US} AND {_AT_US} < ends",
    "silence_gc": f"{_BASE} SELECT id FROM good WHERE ends > {_AT_US}",
    "silence_listing": f"{_BASE} SELECT id, CASE WHEN {_AT_US} < starts THEN 'pending' WHEN {_AT_US} < ends THEN 'active' ELSE 'expired' END AS status FROM good",
    "silence_mutes": f"{_BASE} SELECT fingerprint, i, {_MUTE.format('us')} AS silenced FROM events_ WHERE status = 'firing'",
    "delivery_silence": f"{_BASE} SELECT fingerprint, i, status FROM events_ WHERE NOT {_MUTE.format('(us + 86400000000)')}",
    "inhibit": f"{_BASE} SELECT fingerprint, i, status, {_INHIBITED} AS inhibited FROM events_ e",
    "forwarded_resolutions": f"{_BASE}, {_FORWARDED} SELECT fingerprint, i, status FROM forwarded",
    "route_receivers": f"{_BASE}, {_ROUTED} SELECT fingerprint, i, status, receiver FROM routed",
    "group_key": f"""{_BASE}, {_ROUTED} SELECT fingerprint, i, receiver, grp AS "group", 'shard=' || shard || ',team=sales' AS labels FROM routed""",
    "group_content_hash": f"""{_BASE}, {_ROUTED} SELECT grp AS "group", us, upper(sha256(string_agg(fingerprint || chr(0) || status || chr(0), '' ORDER BY fingerprint))) AS content FROM routed GROUP BY grp, us""",
    "group_status_counts": f"""{_BASE}, {_ROUTED} SELECT grp AS "group", us, CASE WHEN count(*) FILTER (WHERE status = 'firing') > 0 THEN 'firing' ELSE 'resolved' END AS status,
        CAST(count(*) FILTER (WHERE status = 'firing') AS INTEGER) AS firing, CAST(count(*) FILTER (WHERE status = 'resolved') AS INTEGER) AS resolved FROM routed GROUP BY grp, us""",
    "group_summary": f"""{_BASE}, {_ROUTED}, placed AS (SELECT *, row_number() OVER (PARTITION BY grp, us ORDER BY fingerprint) AS place FROM routed)
SELECT grp AS "group", us, string_agg(CASE WHEN place = 11 THEN '…' ELSE status || ' HighPurchase agent_id="' || agent_id || '", alertname="HighPurchase", severity="critical", shard="' || shard || '", team="sales"' END, chr(10) ORDER BY place) AS summary
FROM placed WHERE place <= 11 GROUP BY grp, us""",
    "notification_payload": f"""{_BASE}, {_ROUTED} SELECT grp AS "group", us, '{{"version":"1","group_key":"' || grp || '","receiver":"' || receiver || '","status":"' ||
        CASE WHEN count(*) FILTER (WHERE status = 'firing') > 0 THEN 'firing' ELSE 'resolved' END || '","group_labels":{{"team":"sales"}},"alerts":[' ||
        string_agg('{{"fingerprint":"' || fingerprint || '","status":"' || status || '"}}', ',' ORDER BY fingerprint) || ']}}' AS body FROM routed GROUP BY grp, receiver, us""",
    "group_notifications": group_sql(f"{GRID.start + GRID.last * GRID.step + 1}"),
    "agents_list": f"""WITH {COUNTERS}, h AS (SELECT agent_id, max(us) AS us, arg_max(value, us) AS uptime, arg_max(tenant, us) AS tenant
    FROM samples WHERE us BETWEEN {GRID.start + GRID.last * GRID.step} - 120 * 3600000000 AND {GRID.start + GRID.last * GRID.step} GROUP BY agent_id)
SELECT agent_id, us, round(uptime, 6) AS uptime, tenant, CASE WHEN {GRID.start + GRID.last * GRID.step} - us > 3 * 3600000000 THEN 'stale' ELSE 'healthy' END AS status FROM h""",
    "median_spread": f"""{_MEASURED} SELECT name, unit, run, count(*) AS n, round(median(value), 6) AS median,
        round(CASE WHEN count(*) < 2 OR median(value) = 0 THEN 0 ELSE (max(value) - min(value)) / 2 / abs(median(value)) * 100 END, 6) AS spread FROM m GROUP BY name, unit, run""",
    "rank_pooled": f"""{_RANKED} SELECT name, unit, run, sum(low + (tied - 1) / 2.0) AS ranks, CAST(sum(tied * tied - 1) AS DOUBLE) AS ties FROM q GROUP BY name, unit, run""",
    "mann_whitney_u": f"{_RANKED}, {_TESTED} SELECT name, unit, n1, n2, u, ties, method FROM tested",
    "mann_whitney": f"{_P_VALUES} SELECT name, unit, n1, n2, u, ties, round(p, 6) AS p, method FROM valued",
    "compare_runs": f"""{_P_VALUES}, s AS (SELECT name, unit, median(value) FILTER (WHERE run = 'old') AS a, median(value) FILTER (WHERE run = 'new') AS b FROM m GROUP BY name, unit)
SELECT name, unit, CASE WHEN n1 = 0 THEN 'new' WHEN n2 = 0 THEN 'old' ELSE 'both' END AS side, round((b - a) / a * 100, 6) AS delta, CASE WHEN n1 > 0 AND n2 > 0 THEN round(p, 6) END AS p,
       CASE WHEN n1 > 0 AND n2 > 0 THEN method END AS method, CASE WHEN n1 > 0 AND n2 > 0 THEN p < {C.ALPHA} END AS significant FROM valued JOIN s USING (name, unit)""",
    "compare_deltas": f"""{_MEASURED}, s AS (
    SELECT name, unit, median(value) FILTER (WHERE run = 'old') AS a, median(value) FILTER (WHERE run = 'new') AS b, count(*) FILTER (WHERE run = 'old') AS n1, count(*) FILTER (WHERE run = 'new') AS n2 FROM m GROUP BY name, unit)
SELECT name, unit, CASE WHEN n1 = 0 THEN 'new' WHEN n2 = 0 THEN 'old' ELSE 'both' END AS side, nullif(n1, 0) AS old_n, nullif(n2, 0) AS new_n, round(a, 6) AS old_median, round(b, 6) AS new_median,
       CASE WHEN n1 > 0 AND n2 > 0 THEN round((b - a) / a * 100, 6) END AS delta FROM s""",
    "load_rules": """SELECT 'rule-' || n_nationkey AS id, n_name AS name, '300s' AS wait, CASE n_regionkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
        'segment=' || r_name AS labels, 'purchase > ' || n_nationkey AS expression, n_nationkey % 2 = 0 AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "load_routing": """SELECT n_name AS receiver, n_regionkey = 0 AS is_default, CAST(n_nationkey AS BIGINT) AS place, CASE WHEN n_regionkey = 0 THEN 'nation=' || n_name END AS inhibits FROM nation""",
}
