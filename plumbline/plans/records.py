"""Sources, validations, selections, joins, sorts and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import identity, scalars
from plumbline.plans.domain import RUN
from plumbline.plans.registry import n, query, r
from plumbline.sources import records

# -- sources ------------------------------------------------------------------------------

_PROPS = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"


def _write_lines(t, name, broken):
    """The event log as JSON lines in eight files, some lines broken on purpose."""
    path = records.scratch(t.spark, name)
    rows = t.read("events", "event_id", "user_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    rows.select(F.when(broken, F.substring(line, 1, 12)).otherwise(line).alias("value"), "event_id").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return path


@query("src01", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id < (SELECT max(event_id) FROM events)", domain=False)
def src01(t):
    """Strict lines: only the last line of a file may be broken; it is set aside."""
    last = t.read("events", "event_id").agg(F.max("event_id")).first()[0]
    rows = records.lines(t.spark, _write_lines(t, "strict", F.col("event_id") == (last if last is not None else -1)))
    return records.reject_middle(records.strict(rows, _PROPS)).select("record.event_id", "record.user_id", "record.event_type", "record.value")


_LINE7 = "'{\"event_id\":' || event_id || ',\"user_id\":'"


@query("evt07", f"lo AS (SELECT event_id % 4 AS part, event_id, event_id = max(event_id) OVER (PARTITION BY event_id % 4) AND event_id % 2 = 0 AS broken, substr({_LINE7}, 1, 14) AS cut FROM events) SELECT CAST(part AS VARCHAR) AS part, count(*) FILTER (NOT broken) AS records, CAST(max(strlen(cut)) FILTER (broken) AS BIGINT) AS cut_bytes, max(sha256(cut)) FILTER (broken) AS cut_sha256, 0 AS again FROM lo GROUP BY part".replace("lo AS", "WITH lo AS", 1), domain=False)
def evt07(t):
    """Broken last lines of two of four logs cut off under a journal; a second repair finds nothing to do."""
    path = records.scratch(t.spark, "repaired")
    rows = t.read("events", "event_id", "user_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    for k in range(4):
        own = rows.where(F.col("event_id") % 4 == k)
        last = own.agg(F.max("event_id")).first()[0]
        broken = (F.col("event_id") == F.lit(last)) & F.lit(k % 2 == 0)
        own.select(F.when(broken, F.substring(line, 1, 14)).otherwise(line).alias("value"), "event_id").coalesce(1).sortWithinPartitions("event_id").select("value").write.text(f"{path}/log/{k}")
    cut = records.recover_tails(t.spark, f"{path}/log/*/part-*", _PROPS, f"{path}/journal")
    again = len(records.recover_tails(t.spark, f"{path}/log/*/part-*", _PROPS, f"{path}/journal"))
    got = t.spark.createDataFrame([(*x,) for x in cut], "file string, cut_bytes bigint, cut_sha256 string").withColumn("part", F.regexp_extract("file", "/log/([0-9])/", 1))
    kept = records.strict(records.lines(t.spark, f"{path}/log/*/part-*"), _PROPS).where("status = 'record'").groupBy(F.regexp_extract("file", "/log/([0-9])/", 1).alias("part")).agg(F.count(F.lit(1)).alias("records"))
    return kept.join(got.drop("file"), "part", "left").select("part", "records", "cut_bytes", "cut_sha256", F.lit(again).alias("again"))


@query("src02", "SELECT message, count(*) AS n FROM (SELECT CASE WHEN event_id % 100 = 7 THEN 'malformed JSON' ELSE 'record' END AS message FROM events) GROUP BY message", domain=False)
def src02(t):
    """Lenient lines: what can't be read is counted and placed."""
    rows = records.lines(t.spark, _write_lines(t, "lenient", F.col("event_id") % 100 == 7))
    good, errors = records.lenient(rows, _PROPS, "event_id")
    return good.select(F.lit("record").alias("message")).unionByName(errors.select("message")).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("src03", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", domain=False)
def src03(t):
    """Parquet as the merged tables are written, read back."""
    path = records.scratch(t.spark, "merged")
    rows = t.read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    records.write_parquet(rows.sortWithinPartitions("o_orderkey"), path)
    return t.spark.read.parquet(path)


@query("src04", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount > 0.05", domain=False)
def src04(t):
    """A scan of named columns; the filter reaches the files."""
    return t.read("lineitem").where("l_discount > 0.05D").select("l_orderkey", "l_quantity")


@query("src05", "SELECT vec_id, label, len(embedding) AS size FROM embeddings WHERE label = 1", domain=False)
def src05(t):
    """The heavy column only where it is asked for."""
    return t.read("embeddings").where("label = 1").select("vec_id", "label", n(F.size("embedding"), "size"))


def _csv(t, name):
    path = records.scratch(t.spark, name)
    rows = t.nat.select("qid", "run_id", "subject", "confidence", "correct")
    records.write_csv(rows, path)
    return path


_CONTRACT = {"qid": ("integer", False), "run_id": ("integer", False), "subject": ("string", False), "confidence": ("finite_float", True), "correct": ("boolean", True)}


@query("src06", "SELECT count(*) AS lines, count(*) FILTER (correct) AS right_runs, count(*) FILTER (confidence IS NULL) AS empty FROM (SELECT *, answer = gold AS correct FROM nat)")
def src06(t):
    """Typed CSV: nulls are empty cells, booleans in lower case."""
    raw = t.spark.read.csv(_csv(t, "csv-cells"), header=True, schema="qid STRING, run_id STRING, subject STRING, confidence STRING, correct STRING")
    return raw.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("correct") == "true").alias("right_runs"), F.count_if(F.col("confidence").isNull()).alias("empty"))


@query("src07", "SELECT qid, run_id, subject, confidence, answer = gold AS correct FROM nat")
def src07(t):
    """Typed CSV read by its contract."""
    return records.read_csv(t.spark, _csv(t, "csv-typed"), _CONTRACT)


@query("src08", "SELECT subject, count(*) AS n, round(avg(confidence), 10) AS confidence FROM nat GROUP BY subject")
def src08(t):
    """A CSV scan of some columns."""
    rows = records.read_csv(t.spark, _csv(t, "csv-some"), _CONTRACT).select("subject", "confidence")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), r(F.avg("confidence"), "confidence"))


@query("src09", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", domain=False)
def src09(t):
    """A JSON lines scan with a given schema."""
    path = _write_lines(t, "frame", F.lit(False))
    return t.spark.read.json(path, schema=_PROPS).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src10", "SELECT source, doc_id, CAST(place AS INT) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents) WHERE place < 10", domain=False)
def src10(t):
    """A seeded take of so many rows from each stratum."""
    return records.sample_by(t.read("documents", "source", "doc_id"), "source", "doc_id", 10)


@query("src11", "SELECT true AS equal, count(*) AS rows FROM customer", domain=False)
def src11(t):
    """A cache on disk holds the same bag of rows."""
    rows = t.read("customer")
    path = records.scratch(t.spark, "cache")
    rows.write.parquet(path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(records.same_bag(rows, t.spark.read.parquet(path))).alias("equal"), "rows")


_COHORT = "co AS (SELECT subject, count(*) AS n, count(*) FILTER (answer = gold) AS c FROM nat GROUP BY subject)"


@query(
    "src12",
    f"{_COHORT} SELECT 'latex' AS sink, line FROM (SELECT unnest(['\\begin{{tabular}}{{lrr}}', 'subject & runs & right \\\\', '\\end{{tabular}}']) AS line UNION ALL SELECT subject || ' & ' || n || ' & ' || c || ' \\\\' FROM co) UNION ALL SELECT 'markdown', line FROM (SELECT unnest(['| subject | runs | right |', '|---|---|---|']) AS line UNION ALL SELECT '| ' || subject || ' | ' || n || ' | ' || c || ' |' FROM co) UNION ALL SELECT 'json', '{{\"subject\":\"' || subject || '\",\"runs\":' || n || ',\"right\":' || c || '}}' FROM co",
)
def src12(t):
    """A report's table written as typeset, Markdown and JSON lines, and read back."""
    got = t.nat.groupBy("subject").agg(F.count(F.lit(1)).alias("runs"), F.count_if("correct").alias("right"))
    out = None
    for sink in ("latex", "markdown", "json"):
        path = records.scratch(t.spark, f"report-{sink}")
        records.write_report(got.orderBy("subject"), path, sink)
        one = t.spark.read.text(path).select(F.lit(sink).alias("sink"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src13", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, true AS refused FROM events", domain=False)
def src13(t):
    """Batches appended to one log under the commit protocol, beside a file that can be made only once."""
    path = records.scratch(t.spark, "log")
    rows = t.read("events", "event_id", "event_type")
    records.create_once(t.spark, f"{path}.header", "event log")
    for k in range(2):
        rows.where(F.col("event_id") % 2 == k).write.mode("append").parquet(path)
    try:
        records.create_once(t.spark, f"{path}.header", "another log")
        refused = False
    except FileExistsError:
        refused = t.spark.read.text(f"{path}.header").first()[0] == "event log"
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids")).withColumn("refused", F.lit(refused))


@query("src14", "SELECT p_partkey, p_name, p_retailprice FROM part", domain=False)
def src14(t):
    """Staged, checked and renamed; a second publication to the same place fails."""
    path = records.scratch(t.spark, "published")
    rows = t.read("part", "p_partkey", "p_name", "p_retailprice")
    records.publish(rows, path)
    try:
        records.publish(rows, path)
    except FileExistsError:
        return t.spark.read.parquet(path)
    raise AssertionError("a published folder was replaced")


# -- validations --------------------------------------------------------------------------


_CONF = "cf AS (SELECT doc_id, CAST(doc_id % 130 AS BIGINT) AS raw, CASE WHEN doc_id % 130 > 100 THEN 'out_of_range' WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'parsed' END AS status, CASE WHEN doc_id % 130 <= 100 AND doc_id % 7 <> 0 THEN (doc_id % 130) / CAST(100 AS DOUBLE) + CASE WHEN doc_id % 11 = 0 THEN 0.001 ELSE 0 END END AS norm FROM documents)"


@query("val02", f"{_CONF} SELECT status, count(*) AS n, count(*) FILTER (status = 'parsed' AND abs(norm - raw / CAST(100 AS DOUBLE)) <= 1e-12 OR status = 'missing' OR status = 'out_of_range' AND raw > 100) AS valid FROM cf GROUP BY status")
def val02(t):
    """Arithmetic of a confidence and its parse status."""
    raw = F.col("doc_id") % 130
    status = F.when(raw > 100, "out_of_range").when(F.col("doc_id") % 7 == 0, "missing").otherwise("parsed")
    norm = F.when((raw <= 100) & (F.col("doc_id") % 7 != 0), raw / F.lit(100.0) + F.when(F.col("doc_id") % 11 == 0, 0.001).otherwise(0.0))
    rows = t.read("documents", "doc_id").select(raw.alias("raw"), status.alias("status"), norm.alias("norm"))
    ok = F.when(F.col("status") == "parsed", F.abs(F.col("norm") - F.col("raw") / 100.0) <= 1e-12).when(F.col("status") == "missing", F.col("norm").isNull()).otherwise(~F.col("raw").between(0, 100))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


_P4 = "a4 AS (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN [2, 3, 5, 8]] AS a FROM embeddings), e4 AS (SELECT vec_id, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM a4), q4 AS (SELECT vec_id, list_transform(e, lambda y: y / list_sum(e)) AS p FROM e4), b4 AS (SELECT vec_id, p, list_max(p) + CASE WHEN vec_id % 9 = 0 THEN 1e-6 ELSE 0 END AS top FROM q4)"


def _probabilities(t):
    rows = t.read("embeddings", "vec_id", "embedding").select("vec_id", F.array(*[F.get("embedding", F.lit(i)).cast("double") for i in (1, 2, 4, 7)]).alias("a"))
    return rows.select("vec_id", scalars.softmax(F.col("a")).alias("p"))


@query("val04", f"{_P4} SELECT vec_id, abs(list_sum(p) - 1) <= 1e-6 AND abs(top - list_max(p)) <= 1e-12 AS valid FROM b4")
def val04(t):
    """Probabilities sum to one and the stored maximum is theirs."""
    rows = _probabilities(t).withColumn("top", F.array_max("p") + F.when(F.col("vec_id") % 9 == 0, 1e-6).otherwise(0.0))
    return rows.select("vec_id", ((F.abs(scalars.total(F.col("p")) - 1) <= 1e-6) & (F.abs(F.col("top") - F.array_max("p")) <= 1e-12)).alias("valid"))


@query("val09", "SELECT qid, run_id, k_keep, count(*) AS members, count(DISTINCT (coalesce(ans, '-'), gold)) = 1 AS consistent FROM ck GROUP BY ALL")
def val09(t):
    """Members of an alias group share what was measured."""
    return t.ck.groupBy(*RUN, "k_keep").agg(F.count(F.lit(1)).alias("members"), (F.count_distinct(F.struct(F.coalesce("ans", F.lit("-")), "gold")) == 1).alias("consistent"))


@query("val16", "m AS (SELECT CASE event_type WHEN 'click' THEN 'prompt hash differs at row ' || event_id WHEN 'view' THEN 'unexpected row ' || event_id ELSE 'record ' || event_id || ' is broken' END AS msg FROM events) SELECT CASE WHEN regexp_matches(msg, '^prompt hash differs at row [0-9]+$') THEN 'prompt_hash' WHEN regexp_matches(msg, '^unexpected row [0-9]+$') THEN 'unexpected' ELSE 'unknown' END AS family, count(*) AS n FROM m GROUP BY family".replace("m AS (", "WITH m AS (", 1), domain=False)
def val16(t):
    """Errors that a waiver may cover: only known families, counted."""
    i = F.col("event_id").cast("string")
    msg = F.when(F.col("event_type") == "click", F.concat(F.lit("prompt hash differs at row "), i)).when(F.col("event_type") == "view", F.concat(F.lit("unexpected row "), i)).otherwise(F.concat(F.lit("record "), i, F.lit(" is broken")))
    family = F.when(msg.rlike("^prompt hash differs at row [0-9]+$"), "prompt_hash").when(msg.rlike("^unexpected row [0-9]+$"), "unexpected").otherwise("unknown")
    return t.read("events", "event_id", "event_type").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


# -- selections ---------------------------------------------------------------------------


@query("sel01", "SELECT qid, run_id, correct FROM ev")
def sel01(t):
    return t.ev.select(*RUN, "correct")


@query("sel02", "SELECT event_id FROM ck WHERE ans IN ('A', 'B', 'C', 'D')")
def sel02(t):
    return t.ck.where(F.col("ans").isin(*scalars.LETTERS)).select("event_id")


_MIXED = "SELECT qid FROM ev GROUP BY qid HAVING count(*) FILTER (correct) > 0 AND count(*) FILTER (correct) < count(*)"


@query("sel05", f"SELECT qid, run_id FROM ev WHERE qid IN ({_MIXED})")
def sel05(t):
    """Runs of questions with right and wrong runs."""
    c = F.count_if("correct")
    mixed = t.ev.groupBy("qid").agg(c.alias("c"), F.count(F.lit(1)).alias("k")).where("c > 0 and c < k")
    return t.ev.join(mixed, "qid", "left_semi").select(*RUN)


@query("sel07", "SELECT qid, run_id, replace(replace(subject, 'high_school_', ''), '_', ' ') AS label FROM nat")
def sel07(t):
    """Labels of subjects by a map."""
    labels = F.create_map(*[F.lit(x) for s in scalars.SUBJECTS for x in (s, s.removeprefix("high_school_").replace("_", " "))])
    return t.nat.select(*RUN, F.element_at(labels, F.col("subject")).alias("label"))


@query("sel09", "SELECT event_id FROM ck WHERE qid IN (SELECT DISTINCT qid FROM ev WHERE correct)")
def sel09(t):
    """Rows of a set of keys."""
    return t.ck.join(t.ev.where("correct").select("qid").distinct(), "qid", "left_semi").select("event_id")


@query("sel10", "SELECT qid % 16 AS shard, count(DISTINCT qid) AS questions, count(*) AS runs FROM nat GROUP BY shard")
def sel10(t):
    """Shards by the question's remainder."""
    return t.nat.withColumn("shard", F.pmod("qid", F.lit(16))).groupBy("shard").agg(F.count_distinct("qid").alias("questions"), F.count(F.lit(1)).alias("runs"))


@query("sel11", "SELECT qid, run_id FROM nat WHERE qid < 5 AND run_id < 2")
def sel11(t):
    """The subset of a smoke run."""
    return t.nat.where("qid < 5 and run_id < 2").select(*RUN)


@query("sel12", "SELECT c.event_id, CASE WHEN n.correct THEN 'final_right' ELSE 'final_wrong' END AS grp FROM ck c JOIN ev n USING (qid, run_id)")
def sel12(t):
    """Checkpoints by the verdict of their last one."""
    return t.ck.join(t.ev.select(*RUN, F.col("correct").alias("final")), RUN).select("event_id", F.when(F.col("final"), "final_right").otherwise("final_wrong").alias("grp"))


# -- joins, sorts, sets -------------------------------------------------------------------


@query("jn02", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey", domain=False)
def jn02(t):
    c = t.read("customer", "c_custkey", "c_name", "c_acctbal").where("c_acctbal > 0")
    return t.read("orders", "o_orderkey", "o_custkey").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "c_acctbal")


@query("jn03", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40", domain=False)
def jn03(t):
    p = t.read("part", "p_partkey", "p_brand", "p_size").where("p_size > 40")
    return t.read("lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("jn04", "SELECT n.qid, n.run_id, a.conf AS first_conf, e.conf AS last_conf FROM nat n JOIN ck a ON a.qid = n.qid AND a.run_id = n.run_id AND a.idx = 0 LEFT JOIN ck e ON e.qid = n.qid AND e.run_id = n.run_id AND e.idx = 10")
def jn04(t):
    """An inner and then a left join: the first checkpoint must be there, the last may."""
    at = lambda i, name: t.ck.where(F.col("idx") == i).select(*RUN, F.col("conf").alias(name))
    return t.nat.select(*RUN).join(at(0, "first_conf"), RUN).join(at(10, "last_conf"), RUN, "left")


@query("jn05", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", domain=False)
def jn05(t):
    c = t.read("customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    return t.read("orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("jn10", "SELECT n.qid, n.run_id, c.conf AS at_half FROM nat n LEFT JOIN ck c ON c.qid = n.qid AND c.run_id = n.run_id AND c.idx = 5")
def jn10(t):
    """The value at one fraction as a column."""
    at = t.ck.where("idx = 5").select(*RUN, F.col("conf").alias("at_half"))
    return t.nat.select(*RUN).join(at, RUN, "left")


@query("jn12", "sh AS (SELECT qid, CASE WHEN qid % 17 = 3 THEN (qid + 1) % 8 ELSE qid % 8 END AS shard FROM nat) SELECT DISTINCT qid, shard, qid % 8 = shard AS owned FROM sh WHERE qid % 8 <> shard")
def jn12(t):
    """Questions in a shard that doesn't own them."""
    shard = F.when(F.col("qid") % 17 == 3, (F.col("qid") + 1) % 8).otherwise(F.col("qid") % 8)
    return t.nat.select("qid", shard.alias("shard")).distinct().withColumn("owned", F.col("qid") % 8 == F.col("shard")).where("not owned")


_AUDIT_KEY = "coalesce(run_id, -1)"


_AUDIT_KEYS = "a AS (SELECT event_id, 'shard-' || lpad(CAST(qid % 16 AS VARCHAR), 3, '0') AS shard_id, CASE WHEN event_id % 50 = 0 THEN 'shard' ELSE 'record' END AS scope, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'q' || lpad(CAST(qid AS VARCHAR), 8, '0') END AS question_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE run_id END AS run, CASE WHEN idx = 0 OR event_id % 50 = 0 THEN NULL ELSE 'cp-' || lpad(CAST(idx AS VARCHAR), 2, '0') END AS checkpoint_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 3 END AS attempt, run_id * 11 + idx AS seq, event_type FROM ck)"


@query("srt01", f"{_AUDIT_KEYS} SELECT event_id, row_number() OVER (PARTITION BY shard_id ORDER BY CASE scope WHEN 'shard' THEN 0 ELSE 1 END, coalesce(question_id, ''), coalesce(run, -1), CASE WHEN checkpoint_id IS NULL THEN -2 ELSE CAST(substr(checkpoint_id, 4) AS INT) END, coalesce(attempt, -1), seq, event_type, event_id) AS place, shard_id FROM a")
def srt01(t):
    """Canonical order of the audit log by nine keys, nulls as -1, -2 or ''; the first key, the shard, splits the sort."""
    whole = F.col("event_id") % 50 == 0
    named = lambda prefix, c, width: F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))
    rows = t.ck.select(
        "event_id",
        named("shard-", F.col("qid") % 16, 3).alias("shard_id"),
        F.when(whole, "shard").otherwise("record").alias("event_scope"),
        F.when(~whole, named("q", F.col("qid"), 8)).alias("question_id"),
        F.when(~whole, F.col("run_id")).alias("run_id"),
        F.when(~whole & (F.col("idx") > 0), named("cp-", F.col("idx"), 2)).alias("checkpoint_id"),
        F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 3).alias("attempt_number"),
        (F.col("run_id") * 11 + F.col("idx")).alias("event_sequence"),
        "event_type",
    )
    shard, *keys = records.audit_keys()
    return rows.select("event_id", n(F.row_number().over(Window.partitionBy(shard).orderBy(*keys)), "place"), "shard_id")


@query("srt02", "SELECT qid, run_id FROM nat ORDER BY qid, run_id")
def srt02(t):
    """Trajectories in order; a range exchange, not one task."""
    return t.nat.select(*RUN).orderBy(*RUN)


@query("srt03", "SELECT DISTINCT qid, subject, CAST(list_position(['high_school_mathematics', 'high_school_physics', 'high_school_chemistry', 'high_school_biology', 'high_school_psychology'], subject) AS INT) AS place FROM nat")
def srt03(t):
    """Questions by the fixed order of subjects."""
    place = F.array_position(F.array(*[F.lit(s) for s in scalars.SUBJECTS]), F.col("subject")).cast("int")
    return t.nat.select("qid", "subject", place.alias("place")).distinct().orderBy("place", "qid")


@query("srt04", "SELECT * FROM (SELECT 'overconfident' AS list, qid, run_id, confidence FROM ev WHERE NOT correct ORDER BY confidence DESC, h_mean, qid, run_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'disagreeing', qid, run_id, confidence FROM ev WHERE confidence >= 0.9 ORDER BY h_mean DESC, qid, run_id LIMIT 10)")
def srt04(t):
    """The ten most confident wrong runs, and the ten confident ones of the highest entropy."""
    wrong = t.ev.where("not correct").orderBy(F.desc("confidence"), "h_mean", *RUN).limit(10)
    odd = t.ev.where("confidence >= 0.9").orderBy(F.desc("h_mean"), *RUN).limit(10)
    return wrong.select(F.lit("overconfident").alias("list"), *RUN, "confidence").unionByName(odd.select(F.lit("disagreeing").alias("list"), *RUN, "confidence"))


_BAL = "c2 AS (SELECT qid, run_id, subject, correct, md5('42:' || qid || ':' || run_id) AS k FROM ev), u2 AS (SELECT *, row_number() OVER (PARTITION BY correct, subject ORDER BY k) AS s FROM c2), o2 AS (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY s > 1, k) AS place FROM u2)"


@query("srt06", f"{_BAL} SELECT qid, run_id, correct FROM o2 WHERE place <= 7")
def srt06(t):
    """A seeded sample of each outcome: one of each subject first, then more."""
    k = F.md5(F.concat_ws(":", F.lit("42"), F.col("qid").cast("string"), F.col("run_id").cast("string")).cast("binary"))
    rows = t.ev.select(*RUN, "subject", "correct", k.alias("k"))
    rows = rows.withColumn("s", F.row_number().over(Window.partitionBy("correct", "subject").orderBy("k"))).where("s <= 7")
    place = F.row_number().over(Window.partitionBy("correct").orderBy(F.col("s") > 1, "k"))
    return rows.withColumn("place", place).where("place <= 7").select(*RUN, "correct")


@query("srt07", "SELECT qid, k_keep, event_id FROM ck ORDER BY qid, k_keep, event_id")
def srt07(t):
    """Shards put together and sorted."""
    parts = [t.ck.where(F.col("qid") % 2 == k).select("qid", "k_keep", "event_id") for k in range(2)]
    return parts[0].unionByName(parts[1]).orderBy("qid", "k_keep", "event_id")


@query("set01", "SELECT count(*) AS rows FROM ck")
def set01(t):
    """The union of shards."""
    parts = [t.ck.where(F.col("qid") % 4 == k).select("event_id") for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.count(F.lit(1)).alias("rows"))


@query("set05", "SELECT true AS same, false AS other FROM region LIMIT 1", domain=False)
def set05(t):
    """Equality of bags of rows."""
    rows = t.read("supplier")
    return t.spark.range(1).select(F.lit(records.same_bag(rows, t.read("supplier").repartition(3))).alias("same"), F.lit(records.same_bag(rows, rows.where("s_acctbal > 0").unionByName(rows.limit(1)))).alias("other"))


# -- identities and text ------------------------------------------------------------------

_ENV = "'{\"serialization_version\":\"part1-canonical-json-v1\",\"value\":'"


@query("fn05", f"SELECT doc_id, {_ENV} || '{{\"chars\":' || n_chars || ',\"lang\":\"' || lang || '\",\"none\":null}}}}' AS canonical FROM documents", domain=False)
def fn05(t):
    rows = t.read("documents", "doc_id", "n_chars", "lang")
    return rows.select("doc_id", identity.canonical_json(identity.json_of(lang=F.col("lang"), none=F.lit(None).cast("string"), chars=F.col("n_chars"))).alias("canonical"))


_ID = f"sha256({_ENV} || '{{\"identity_type\":\"question_id\",\"identity_version\":\"part1-identity-v1\",\"payload\":{{\"lang\":\"' || lang || '\",\"row\":' || doc_id || '}}}}}}')"


@query("fn06", f"SELECT doc_id, {_ID} AS identity FROM documents", domain=False)
def fn06(t):
    return t.read("documents", "doc_id", "lang").select("doc_id", identity.identity("question_id", row=F.col("doc_id"), lang=F.col("lang")).alias("identity"))


_SEED = f"sha256({_ENV} || '{{\"base_seed\":42,\"question_id\":\"' || doc_id || '\",\"run_id\":' || doc_id % 10 || ',\"seed_algorithm_version\":\"part1-seed-v1\"}}}}')"


@query("fn07", f"SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT & 2147483647 AS BIGINT) * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT AS seed FROM (SELECT doc_id, {_SEED} AS h FROM documents)", domain=False)
def fn07(t):
    return t.read("documents", "doc_id").select("doc_id", identity.seed(base_seed=F.lit(42), question_id=F.col("doc_id").cast("string"), run_id=F.col("doc_id") % 10).alias("seed"))


@query("fn08", "SELECT DISTINCT n_think, idx, k_keep, alias FROM ck")
def fn08(t):
    """Tokens kept at each tenth, and which repeat an earlier one."""
    return t.ck.select("n_think", "idx", "k_keep", "alias").distinct()


@query("fn16", "SELECT event_id, ans = gold AS correct FROM ck")
def fn16(t):
    return t.ck.select("event_id", scalars.correct(F.col("ans"), F.col("gold")).alias("correct"))


@query("fn24", "SELECT p_partkey, p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS prompt FROM part", domain=False)
def fn24(t):
    return t.read("part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", scalars.prompt(F.col("p_name"), F.array("p_brand", "p_type")).alias("prompt"))


@query("fn28", "SELECT event_id, CASE WHEN k_keep = 0 THEN 'no_reasoning_baseline' WHEN k_keep >= n_think THEN 'full_chain' ELSE 'partial_reasoning' END AS label FROM ck")
def fn28(t):
    return t.ck.select("event_id", scalars.intervention(F.col("k_keep"), F.col("n_think")).alias("label"))


@query("fn30", "SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS snippet FROM documents", domain=False)
def fn30(t):
    return t.read("documents", "doc_id", "text").select("doc_id", scalars.snippet(F.col("text"), 60).alias("snippet"))
