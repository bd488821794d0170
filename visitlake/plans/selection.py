"""Registered queries: per-group selection, queues and policy comparisons over half-day sessions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queue, running, selection
from . import views as V
from .catalog import query
from .oracle import big, day_text, num, with_views
from .research import mean_ci_sql

KEYS = ["day", "half_day"]
ORDER = ["at_us", "event_id"]
T = 720.0
NUMBERED = """nb AS (SELECT *, row_number() OVER (PARTITION BY day, half_day ORDER BY at_us, event_id) AS position,
  count(*) OVER (PARTITION BY day, half_day) AS n_group FROM sessions)"""
ROW = f"{day_text('{t}.day', 'day')}, half_day, event_id"


def row(t: str) -> str:
    return ROW.format(t=t)


@query("every_kth", with_views(["sessions"], f"WITH {NUMBERED} SELECT {row('nb')}, {big('position', 'position')} FROM nb WHERE position % 3 = 0"))
def every_kth(spark, sf):
    return selection.every_kth(V.sessions(spark, sf), KEYS, ORDER, 3).select(*KEYS, "event_id", "position")


@query("topm_per_group", with_views(["sessions"], f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY day, half_day ORDER BY risk DESC, at_us, event_id) AS place FROM sessions)
SELECT {row('r')}, {num('risk', 'risk')}, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5"""))
def topm_per_group(spark, sf):
    s = V.sessions(spark, sf)
    return selection.top_m(s, KEYS, [F.desc("risk"), F.col("at_us"), F.col("event_id")], 5).select(*KEYS, "event_id", "risk", "place")


ORACLE_RANK = "CASE WHEN attends THEN 0.0 ELSE 10.0 END + risk"
MATCHED = "m AS (SELECT day, half_day, count(*) FILTER (risk >= 0.8) AS m FROM sessions GROUP BY 1, 2)"


@query("topm_matched", with_views(["sessions"], f"""
WITH {MATCHED}, r AS (SELECT s.*, m.m, row_number() OVER (PARTITION BY s.day, s.half_day ORDER BY {ORACLE_RANK} DESC, at_us, event_id) AS place
  FROM sessions s JOIN m ON m.day = s.day AND m.half_day = s.half_day)
SELECT {row('r')}, {big('place', 'place')} FROM r WHERE place <= m"""))
def topm_matched(spark, sf):
    """As many rows as have a risk of 0.8, but knowing who stays away: absent patients first, then by risk."""
    s = V.sessions(spark, sf)
    m = s.groupBy(*KEYS).agg(F.count_if(F.col("risk") >= 0.8).alias("m"))
    rows = s.join(m, KEYS).withColumn("rank", -(F.when(F.col("attends"), 0.0).otherwise(10.0) + F.col("risk")))
    return selection.top_m_of(rows, KEYS, ["rank", *ORDER], "m").select(*KEYS, "event_id", "place")


@query("evenly_spaced", with_views(["sessions"], f"""
WITH {NUMBERED}, {MATCHED}, g AS (SELECT DISTINCT nb.day, nb.half_day, nb.n_group, m.m FROM nb JOIN m ON m.day = nb.day AND m.half_day = nb.half_day WHERE m.m > 0),
j AS (SELECT day, half_day, CAST(floor((unnest(range(0, m)) + 0.5) * n_group / m) AS BIGINT) + 1 AS position FROM g)
SELECT DISTINCT {row('nb').replace('half_day', 'nb.half_day')}, {big('nb.position', 'position')} FROM nb JOIN j ON j.day = nb.day AND j.half_day = nb.half_day AND j.position = nb.position"""))
def evenly_spaced(spark, sf):
    s = V.sessions(spark, sf)
    m = s.groupBy(*KEYS).agg(F.count_if(F.col("risk") >= 0.8).alias("m"))
    return selection.evenly_spaced(s.join(m, KEYS), KEYS, ORDER, F.col("m")).select(*KEYS, "event_id", "position")


@query("positional_join", with_views(["sessions"], f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY day, half_day ORDER BY at_us, event_id) AS j FROM sessions WHERE risk >= 0.7),
x AS (SELECT *, row_number() OVER (PARTITION BY day, half_day ORDER BY service, event_id) AS j FROM sessions)
SELECT {row('c').replace('event_id', 'c.event_id').replace('half_day', 'c.half_day')}, {big('c.j', 'j')}, x.event_id AS extra_event_id, {num('x.service', 'extra_service')}
FROM c JOIN x ON x.day = c.day AND x.half_day = c.half_day AND x.j = c.j"""))
def positional_join(spark, sf):
    s = V.sessions(spark, sf)
    out = selection.positional_join(s.where(F.col("risk") >= 0.7), s, KEYS, ORDER, ["service", "event_id"])
    return out.select(*KEYS, "event_id", "j", "extra_event_id", "extra_service")


@query("score_whatif", with_views(["scored"], f"""
WITH st(kind, amount) AS (VALUES ('shift', -0.10::DOUBLE), ('shift', -0.05), ('shift', 0.0), ('shift', 0.05), ('shift', 0.10), ('scale', 0.5), ('scale', 1.0), ('scale', 1.5)),
seen AS (SELECT kind, amount, least(greatest(CASE WHEN kind = 'shift' THEN p + amount ELSE p * amount END, 0.0), 1.0) AS v,
  CASE WHEN kind = 'shift' THEN p ELSE least(greatest(p * amount, 0.0), 1.0) END AS pool FROM scored, st),
q AS (SELECT kind, amount, quantile_cont(pool, [0.5, 0.7, 0.8, 0.9, 0.95]) AS qs FROM seen GROUP BY 1, 2),
lv AS (SELECT kind, amount, unnest(['0.3', '0.5', 'p50', 'p70', 'p80', 'p90', 'p95']) AS threshold_label,
  unnest(list_concat([0.3::DOUBLE, 0.5::DOUBLE], qs)) AS threshold FROM q)
SELECT {big('count(*)', 'n')}, s.kind, {num('s.amount', 'amount')}, threshold_label, {num('threshold', 'threshold')},
  {big('count(*) FILTER (v >= threshold)', 'flagged_n')}, {num('count(*) FILTER (v >= threshold) / CAST(count(*) AS DOUBLE)', 'share_flagged')}
FROM seen s JOIN lv ON lv.kind = s.kind AND lv.amount = s.amount GROUP BY s.kind, s.amount, threshold_label, threshold"""))
def score_whatif(spark, sf):
    return selection.score_whatif(V.scored(spark, sf), "p")


# ---- queues --------------------------------------------------------------------------------------------------------
LOOP_SQL = """a AS (SELECT day, half_day, event_id, arrival, service, row_number() OVER (PARTITION BY day, half_day ORDER BY at_us, event_id) AS i FROM sessions WHERE attends),
q AS (SELECT day, half_day, event_id, arrival, i, arrival AS st, arrival + service AS en FROM a WHERE i = 1
  UNION ALL SELECT a.day, a.half_day, a.event_id, a.arrival, a.i, greatest(a.arrival, q.en), greatest(a.arrival, q.en) + a.service
  FROM q JOIN a ON a.day = q.day AND a.half_day = q.half_day AND a.i = q.i + 1)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("queue_timeline", recursive(with_views(["sessions"], f"""
WITH {LOOP_SQL}
SELECT {row('s').replace('half_day', 's.half_day').replace('event_id', 's.event_id')}, {num('st', 'start')}, {num('en', 'end')}, {num('st - s.arrival', 'wait')}
FROM sessions s LEFT JOIN q ON q.event_id = s.event_id""".replace("AS end", 'AS "end"'))))
def queue_timeline(spark, sf):
    return queue.queue_timeline(V.sessions(spark, sf), KEYS, ORDER).select(*KEYS, "event_id", "start", "end", "wait")


@query("queue_metrics", recursive(with_views(["sessions"], f"""
WITH {LOOP_SQL}
SELECT {day_text('s.day', 'day')}, s.half_day, count(q.event_id) AS served, {num('avg(st - s.arrival)', 'mean_wait')},
  {num(f'greatest(0.0, coalesce(max(en), 0) - {T})', 'overtime')}, {num(f'{T} - coalesce(sum(greatest(0.0, least(en, {T}) - least(st, {T}))), 0)', 'idle')}
FROM sessions s LEFT JOIN q ON q.event_id = s.event_id GROUP BY s.day, s.half_day""")))
def queue_metrics(spark, sf):
    return queue.queue_metrics(queue.queue_timeline(V.sessions(spark, sf), KEYS, ORDER), KEYS, T)


def policy_frames(spark, sf):
    s = V.sessions(spark, sf)
    slots = running.positions(s, KEYS, ORDER, "seq").select(*KEYS, "seq", "arrival", "service", "attends", "risk")
    extras = running.positions(s, KEYS, ["service", "event_id"], "seq").select(*KEYS, "seq", "arrival", "service", "attends")
    chosen = queue.standard_policies(slots, KEYS, "risk", (2, 6), {"0.8": F.lit(0.8)})
    return queue.policy_queue(slots, extras, KEYS, chosen, T)


POLICY_SQL = f"""sl AS (SELECT day, half_day, row_number() OVER (PARTITION BY day, half_day ORDER BY at_us, event_id) AS seq, arrival, service, attends, risk FROM sessions),
ex AS (SELECT day, half_day, row_number() OVER (PARTITION BY day, half_day ORDER BY service, event_id) AS j, service, attends FROM sessions),
ch AS (SELECT 'P1 k=2' AS policy, * FROM sl WHERE seq % 2 = 0 UNION ALL SELECT 'P1 k=6', * FROM sl WHERE seq % 6 = 0 UNION ALL SELECT 'P2 0.8', * FROM sl WHERE risk >= 0.8),
cj AS (SELECT *, row_number() OVER (PARTITION BY policy, day, half_day ORDER BY seq) AS j FROM ch),
pl(policy) AS (VALUES ('P0'), ('P1 k=2'), ('P1 k=6'), ('P2 0.8')),
rw AS (SELECT policy, day, half_day, seq, 0 AS half, arrival, service, attends, 0 AS doubled, 0 AS bth FROM sl, pl
  UNION ALL SELECT c.policy, c.day, c.half_day, c.seq, 1, c.arrival, e.service, e.attends, 1, CASE WHEN c.attends AND e.attends THEN 1 ELSE 0 END
  FROM cj c JOIN ex e ON e.day = c.day AND e.half_day = c.half_day AND e.j = c.j),
s0 AS (SELECT *, CASE WHEN attends THEN service ELSE 0 END AS u FROM rw),
s1 AS (SELECT *, sum(u) OVER (PARTITION BY policy, day, half_day ORDER BY seq, half) AS cs FROM s0),
s2 AS (SELECT *, cs + max(CASE WHEN attends THEN arrival - (cs - u) END) OVER (PARTITION BY policy, day, half_day ORDER BY seq, half) AS en FROM s1),
s3 AS (SELECT policy, day, half_day, doubled, bth, attends, arrival, CASE WHEN attends THEN en END AS en, CASE WHEN attends THEN en - u END AS st FROM s2),
mt AS (SELECT policy, day, half_day, CAST(count(*) FILTER (attends) AS DOUBLE) AS served, avg(st - arrival) AS mean_wait, greatest(0.0, coalesce(max(en), 0) - {T}) AS overtime,
  {T} - coalesce(sum(greatest(0.0, least(en, {T}) - least(st, {T}))), 0) AS idle, CAST(max(bth) AS DOUBLE) AS both_attend, sum(doubled) AS double_slots, sum(bth) AS both_slots
  FROM s3 GROUP BY 1, 2, 3),
lg AS (SELECT policy, day, half_day, unnest(['served', 'mean_wait', 'overtime', 'idle', 'both_attend']) AS metric, unnest([served, mean_wait, overtime, idle, both_attend]) AS value FROM mt)"""


@query("policy_summary", with_views(["sessions"], f"""
WITH {POLICY_SQL}, ci AS ({mean_ci_sql('lg', 'policy, metric', 'value')}),
d AS (SELECT policy, avg(double_slots) AS a, CASE WHEN sum(double_slots) > 0 THEN sum(both_slots) / CAST(sum(double_slots) AS DOUBLE) END AS b FROM mt GROUP BY 1)
SELECT ci.*, {num('d.a', 'double_slots_mean')}, {num('d.b', 'share_both')} FROM ci JOIN d ON d.policy = ci.policy"""))
def policy_summary(spark, sf):
    return queue.policy_summary(policy_frames(spark, sf), KEYS)


@query("policy_paired", with_views(["sessions"], f"""
WITH {POLICY_SQL}, df AS (SELECT a.policy, a.metric, a.value - b.value AS diff FROM lg a JOIN lg b ON b.policy = 'P0' AND b.day = a.day AND b.half_day = a.half_day AND b.metric = a.metric
  WHERE a.policy <> 'P0')
{mean_ci_sql('df', 'policy, metric', 'diff')}"""))
def policy_paired(spark, sf):
    return queue.policy_paired(policy_frames(spark, sf), KEYS, "P0")


COSTS_SQL = "(VALUES ('light', 0.5::DOUBLE, 1.0::DOUBLE), ('moderate', 1.0, 2.0), ('heavy', 2.0, 4.0)) c(costs, w, o)"


@query("policy_reward", with_views(["sessions"], f"""
WITH {POLICY_SQL}, r AS (SELECT costs, policy, served - w * served * coalesce(mean_wait, 0) / 60 - o * overtime / 60 AS reward FROM mt, {COSTS_SQL})
{mean_ci_sql('r', 'costs, policy', 'reward')}"""))
def policy_reward(spark, sf):
    from ..operators.profile import mean_ci

    prices = spark.sql(f"SELECT * FROM {COSTS_SQL}")  # three rows
    priced = policy_frames(spark, sf).crossJoin(F.broadcast(prices))
    net = F.expr("served - (w * served * coalesce(mean_wait, 0) + o * overtime) / 60")
    return mean_ci(priced.withColumn("reward", net), ["costs", "policy"], "reward")
