"""The flow from texts to a report with scores that the operators make: pattern bank, segments against the baseline, fluency, and
their mean, on the split's roles. The score table is written once a session and read by the reports.

The encoder and the language model are the stand-ins of ``operators.segmented`` and ``operators.fluency``; their figures say nothing of
neural models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.patterns import pattern_score
from sievelight.operators import fluency, metrics, report, segmented, split, threshold
from sievelight.operators.ordered import wide_quantiles
from sievelight.plans.base import METHODS, POOL, SIGNALS, _pattern_sql, draw_sql, pool, signals, written, written_part
from sievelight.plans.catalog import METRICS_SQL, SPLIT, _assigned, auc_sql, query, r6, rates_sql
from sievelight.schema import draw

E2E = ["pattern", "embedding", "fluency", "naive"]
BUDGET = 0.05


def _make_scores(spark, d) -> DataFrame:
    rows = written_part(spark, _assigned(spark, d).where("role <> 'dropped'").select("id", "text", "label", "source", "attack_type", "domain", "group", "role"))
    baseline = rows.where("role = 'baseline'").select("id", "text")
    near = segmented.segmented_anomaly(rows.select("id", "text"), baseline)
    model = fluency.UnigramModel.fit(baseline)
    ppl = fluency.perplexity(rows.select("id", "text"), model).select("id", "perplexity", F.col("n_tokens"))
    kept = written_part(spark, ppl)
    band = wide_quantiles(kept.join(baseline.select("id"), "id", "left_semi"), ["perplexity"], [0.05, 0.95]).first()[0] or [1.0, 2.0]
    low, high = band[0] / 2, band[1]
    smooth = kept.select("id", F.expr("perplexity"), fluency.perplexity_score(F.col("perplexity"), low, high).alias("fluency"))
    out = rows.withColumn("pattern", pattern_score(F.col("text"))).drop("text").join(near.select("id", "segments", F.col("max_score").alias("embedding"), "blended"), "id").join(smooth, "id")
    return out.withColumn("naive", (F.col("pattern") + F.col("embedding") + F.col("fluency")) / 3)


def score_table(spark, d) -> DataFrame:
    """One slim row per document: id, label, source, attack_type, domain, group, role and the scores."""
    return written(spark, d, "scores", _make_scores)


def long_table(spark, d) -> DataFrame:
    return threshold.long_scores(score_table(spark, d), E2E, ["id", "label", "source", "attack_type", "role"])


_VEC = f"list_transform(range(64), lambda b: len(list_filter(h, lambda y: y = b))::DOUBLE)"
_HASHES = f"list_transform(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: ({draw_sql('x')}) % 64)"
_UNIT = "CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END"
SCORED = rf"""{SPLIT}, kept AS (SELECT * FROM assigned WHERE role <> 'dropped'),
sg AS (SELECT id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\S+')) >= 3) AS g FROM kept),
seg AS (SELECT id, unnest(CASE WHEN len(g) = 0 THEN [text] ELSE g END) AS t FROM sg),
sv AS (SELECT id, {_UNIT} AS v FROM (SELECT id, {_VEC} AS v FROM (SELECT id, {_HASHES} AS h FROM seg))),
bv AS (SELECT {_UNIT} AS v FROM (SELECT {_VEC} AS v FROM (SELECT {_HASHES} AS h FROM (SELECT text AS t FROM kept WHERE role = 'baseline')))),
near AS (SELECT id, greatest(0, least(1, (1 - max(list_dot_product(sv.v, bv.v))) / 2)) AS a FROM (SELECT id, v, row_number() OVER () AS r FROM sv) sv, bv GROUP BY id, r),
emb AS (SELECT id, count(*) AS segments, max(a) AS embedding, 0.5 * max(a) + 0.5 * avg(a) AS blended FROM near GROUP BY id),
every AS (SELECT id, role, regexp_extract_all(lower(text), '[^ \t\n\r\f\v]+') AS w FROM kept), tok AS (SELECT id, role, w[1:1024] AS w FROM every),
lm AS (SELECT w, count(*) AS k FROM (SELECT unnest(w) AS w FROM every WHERE role = 'baseline') GROUP BY w), lt AS (SELECT sum(k)::DOUBLE AS n, count(*) AS v FROM lm),
ppl AS (SELECT id, exp(-avg(ln((coalesce(k, 0) + 1) / (n + v + 1)))) AS p FROM (SELECT id, unnest(w) AS w FROM tok WHERE len(w) >= 2) LEFT JOIN lm USING (w), lt GROUP BY id),
band AS (SELECT quantile_cont(p, 0.05) / 2 AS lo, quantile_cont(p, 0.95) AS hi FROM ppl JOIN tok USING (id) WHERE role = 'baseline'),
flu AS (SELECT kept.id, CASE WHEN p IS NULL THEN 0 WHEN p < lo THEN least(1, (lo - p) / lo) WHEN p > hi THEN least(1, (p - hi) / hi) ELSE 0 END AS fluency FROM kept LEFT JOIN ppl USING (id), band),
e2e AS (SELECT id, label, source, attack_type, domain, grp, role, {_pattern_sql('text')} AS pattern, segments, embedding, blended, fluency FROM kept JOIN emb USING (id) JOIN flu USING (id)),
scored AS (SELECT *, (pattern + embedding + fluency) / 3 AS naive FROM e2e)"""
LONG = SCORED + ", long AS (" + " UNION ALL ".join(f"SELECT id, label, source, attack_type, role, '{m}' AS method, round({m}, 9) AS score FROM scored" for m in E2E) + ")"


def _rounded(spark, d) -> DataFrame:
    return long_table(spark, d).withColumn("score", F.round("score", 9))


@query(f"WITH {SCORED} SELECT id, role, pattern, segments, round(embedding, 5) AS embedding, round(blended, 5) AS blended, round(fluency, 5) AS fluency, round(naive, 5) AS naive FROM scored")
def e2e_scores(spark, d):
    """Scores of every document by the operators."""
    return score_table(spark, d).select("id", "role", "pattern", "segments", *(F.round(c, 5).alias(c) for c in ("embedding", "blended", "fluency", "naive")))


def _protocol_sql(role: str) -> str:
    return f"""thr AS (SELECT method, quantile_cont(score, {1 - BUDGET}) AS thr FROM long WHERE role = 'val' AND label = 0 GROUP BY method),
cnt AS (SELECT method, thr, {rates_sql('score > thr', '')} FROM long JOIN thr USING (method) WHERE role = '{role}' GROUP BY method, thr UNION ALL SELECT 'flag all', NULL, count(*) FILTER (label = 1), count(*) FILTER (label = 0), 0, 0 FROM scored WHERE role = '{role}'),
pa AS (SELECT a.method, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM long a JOIN long b ON a.method = b.method AND a.label = 1 AND b.label = 0 WHERE a.role = '{role}' AND b.role = '{role}' GROUP BY a.method),
rep AS (SELECT method, round(thr, 5) AS thr, tp, fp, fn, tn, {METRICS_SQL}, round(auc, 6) AS auc FROM cnt LEFT JOIN pa USING (method))"""


def _protocol(spark, d, role: str) -> DataFrame:
    return r6(report.protocol_table(_rounded(spark, d), role=role, budget=BUDGET), "precision", "recall", "f1", "fpr", "auc").withColumn("thr", F.round("thr", 5))


@query(f"""WITH {LONG}, {_protocol_sql('test')} SELECT *, CASE WHEN fp + tn = 0 THEN 'no clean documents' WHEN fp = 0 THEN 'at most ' || printf('%.1f', round_even(30000.0::DOUBLE / (fp + tn), 1)) ELSE printf('%.1f', round_even(10000 * fp::DOUBLE / (fp + tn), 1)) END AS alarms FROM rep""")
def e2e_report(spark, d):
    """Thresholds at the budget on validation rows, everything else on test rows, and a row that flags all."""
    return _protocol(spark, d, "test")


@query(f"""WITH {LONG}, {_protocol_sql('val')}, dry AS (SELECT method, recall AS dry FROM rep), {_protocol_sql('test').replace('thr AS', 'thr2 AS', 1).replace('JOIN thr ', 'JOIN thr2 ').replace('cnt AS', 'cnt2 AS').replace('FROM cnt ', 'FROM cnt2 ').replace('pa AS', 'pa2 AS').replace('JOIN pa ', 'JOIN pa2 ').replace('rep AS', 'rep2 AS')}
SELECT method, dry, recall AS final, round(recall - dry, 6) AS change, CASE WHEN round(recall - dry, 9) >= -0.05 THEN 'PASS' ELSE 'CHECK' END AS status FROM dry JOIN rep2 USING (method)""")
def e2e_dry_run_check(spark, d):
    """Recall on validation rows beside that on test rows."""
    return r6(report.compare_runs(_protocol(spark, d, "val"), _protocol(spark, d, "test"), "recall"), "change")


CLAIMS = [("pattern", 0.5), ("naive", 0.5), ("embedding", None), ("absent", 0.1)]
_CLAIMS_SQL = ", ".join(f"('{n}', {'NULL' if v is None else v})" for n, v in CLAIMS)


@query(f"""WITH {LONG}, {_protocol_sql('test')}, claims(name, claimed) AS (VALUES {_CLAIMS_SQL})
SELECT name, claimed::DOUBLE AS claimed, recall AS found, CASE WHEN claimed IS NULL THEN 'INFO' WHEN round(abs(claimed - recall), 9) <= 0.0051 THEN 'PASS' ELSE 'CHECK' END AS status FROM claims LEFT JOIN rep ON method = name""")
def claim_checks(spark, d):
    """Printed recalls against computed ones."""
    facts = _protocol(spark, d, "test").select(F.col("method").alias("name"), F.col("recall").alias("found"))
    return report.check_claims(spark.createDataFrame(CLAIMS, "name string, claimed double"), facts)


@query(f"""WITH {LONG}, thr AS (SELECT quantile_cont(score, 0.95) AS thr FROM long WHERE role = 'val' AND label = 0 AND method = 'naive'), f AS (SELECT source, attack_type, label, score > thr AS flag FROM long, thr WHERE role = 'test' AND method = 'naive'),
c AS (SELECT CASE GROUPING(source, attack_type) WHEN 3 THEN 'all' WHEN 1 THEN source ELSE attack_type END AS cell, {rates_sql('flag', '')} FROM f GROUP BY GROUPING SETS ((), (source), (attack_type))) SELECT cell, tp, fp, fn, tn, {METRICS_SQL} FROM c""")
def e2e_rates(spark, d):
    """Rates of the fused score per source and attack on test rows."""
    rows = _rounded(spark, d).where("method = 'naive'")
    thr = threshold.at_budgets(rows.where("role = 'val'"), [BUDGET])
    flagged = rows.where("role = 'test'").join(F.broadcast(thr), "method").withColumn("flag", F.col("score") > F.col("thr"))
    return r6(metrics.rates_by(flagged), "precision", "recall", "f1", "fpr")


@query(f"""WITH {POOL}, w AS (SELECT id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') AS w FROM pool), c AS (SELECT id, w, (1 + greatest(0, ceil((len(w) - 510) / 446.0::DOUBLE)))::BIGINT AS windows, 0 AS truncated FROM w WHERE len(w) > 0),
x AS (SELECT id, windows, truncated, unnest(list_transform(range(windows), lambda k: w[446 * k + 1 : 446 * k + 510])) AS t FROM c),
l AS (SELECT id, windows, truncated, {draw_sql("'a'", "t[1]", "len(t)")} / 268435456.0::DOUBLE * 4 AS a, {draw_sql("'b'", "t[1]", "len(t)")} / 268435456.0::DOUBLE * 4 AS b, {draw_sql("'c'", "t[1]", "len(t)")} / 268435456.0::DOUBLE * 4 AS c FROM x),
m AS (SELECT id, max(windows) AS windows, max(truncated) AS truncated, max(b - ln(exp(a) + exp(c))) AS m FROM l GROUP BY id) SELECT id, round(m, 6) AS margin, windows, round(1 / (1 + exp(-m)), 6) AS probability, truncated FROM m""")
def windowed_classifier(spark, d):
    """The windowed classifier with a stand-in model that is fed all token windows of every text (D8); so no text is truncated."""

    def model(windows: DataFrame) -> DataFrame:
        value = F.array(*(draw(F.lit(k), F.element_at("tokens", 1), F.size("tokens").cast("string")) / float(1 << 28) * 4 for k in "abc"))
        return windows.select("id", "window", value.alias("value"))

    out = fluency.classify(pool(spark, d), model, ["safe", "INJECTION", "other"], most=None)
    return r6(out, "margin", "probability")


# --- further report rows ----------------------------------------------------------------------------------------------


@query(f"WITH {POOL}, c AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS r, count(*) OVER () AS n FROM pool WHERE label = 0) SELECT id, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'baseline' ELSE 'evaluation' END AS role FROM c")
def clean_split(spark, d):
    """70 per cent of the clean rows are the baseline."""
    return split.clean_split(pool(spark, d)).select("id", "role")


@query(f"""WITH {POOL}, o AS (SELECT id, source, label, grp, md5('42|' || id) AS key FROM pool), g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key, id) AS r FROM o),
k AS (SELECT id, source, label, row_number() OVER (PARTITION BY source, label ORDER BY key, id) AS rank FROM g WHERE r = 1) SELECT id, source, label, rank FROM k WHERE rank <= 20""")
def blind_audit(spark, d):
    """Twenty rows of each source and label, no group twice."""
    return report.blind_audit(pool(spark, d))


@query(f"""WITH {POOL}, s AS (SELECT id, ({draw_sql("'verdict'", "id")} % 4 = 0)::INT AS verdict FROM pool UNION ALL SELECT -1, 1), j AS (SELECT s.id, verdict, label FROM s LEFT JOIN pool USING (id))
SELECT CASE WHEN label IS NULL THEN 'unknown id' WHEN verdict = label THEN 'agreed' ELSE 'differs' END AS status, count(*) AS n FROM j GROUP BY 1""")
def audit_join(spark, d):
    """A filled audit sheet against its key, unknown ids told apart."""
    p = pool(spark, d)
    sheet = p.select("id", (draw(F.lit("verdict"), F.col("id").cast("string")) % 4 == 0).cast("int").alias("verdict")).unionAll(spark.createDataFrame([(-1, 1)], "id long, verdict int"))
    return report.join_audit(sheet, p).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIGNALS}, l AS (SELECT unnest(['pattern', 'embedding', 'perplexity', 'sentence']) AS stage, unnest([pattern, embedding * 30, perplexity * 30, sentence * 2]) AS ms FROM signals), m AS (SELECT stage, median(ms) AS median_ms FROM l GROUP BY stage)
SELECT stage, round(median_ms, 6) AS median_ms, row_number() OVER (ORDER BY median_ms, list_position(['pattern', 'embedding', 'perplexity', 'sentence'], stage))::INT AS place FROM m""")
def stage_order(spark, d):
    """Stages by their median cost."""
    cost = F.map_from_arrays(F.array(*map(F.lit, METHODS)), F.array(F.col("pattern"), F.col("embedding") * 30, F.col("perplexity") * 30, F.col("sentence") * 2))
    return r6(report.stage_order(signals(spark, d).select(F.explode(cost).alias("detector", "ms")), METHODS), "median_ms")


@query(f"""WITH {SIGNALS}, d AS (SELECT source AS design, avg((sentence > 0.6)::INT) FILTER (label = 1) AS tpr, avg((sentence > 0.6)::INT) FILTER (label = 0) AS fpr, avg(embedding * 30) FILTER (label = 0) AS ms_clean FROM signals GROUP BY source)
SELECT design, 'Design ' || design || ' finds ' || coalesce(printf('%.2f', round_even(100 * tpr, 2)), 'no') || '% of poisoned documents with ' || coalesce(printf('%.2f', round_even(100 * fpr, 2)), 'no') || '% false alarms at ' || coalesce(printf('%.2f', round_even(ms_clean, 2)), 'no') || ' ms per clean document, ' || coalesce(printf('%.2f', round_even(100.0::DOUBLE * (1 - ms_clean / 32.86), 2)), 'no') || '% less than all stages.' AS sentence FROM d""")
def cascade_conclusions(spark, d):
    """A sentence per design; sources stand for designs here."""
    flag = (F.col("sentence") > 0.6).cast("int")
    at = lambda c, label: F.avg(F.when(F.col("label") == label, c))
    rows = signals(spark, d).groupBy(F.col("source").alias("design")).agg(at(flag, 1).alias("tpr"), at(flag, 0).alias("fpr"), at(F.col("embedding") * 30, 0).alias("ms_clean")).withColumn("ms_all", F.lit(32.86))
    return report.conclusions(rows)


_AUCS = f"""{SIGNALS}, a AS (SELECT unnest(['F0', 'F1', 'F2', 'F3']) AS features, unnest([pattern, embedding, perplexity, sentence]) AS score, label FROM signals),
u AS (SELECT features, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM a GROUP BY ALL), v AS (SELECT features, p * (sum(n) OVER (PARTITION BY features ORDER BY score) - n + n / 2.0::DOUBLE) AS w, p, n FROM u),
auc AS (SELECT features, sum(w) / (sum(p) * sum(n))::DOUBLE AS auc FROM v GROUP BY features)"""


def _feature_aucs(spark, d) -> DataFrame:
    each = F.map_from_arrays(F.array(*map(F.lit, ["F0", "F1", "F2", "F3"])), F.array(*METHODS))
    return metrics.roc_auc(signals(spark, d).select("label", F.explode(each).alias("features", "score")), ["features"])


@query(f"WITH {_AUCS}, b AS (SELECT max({{'auc': auc, 'variant': features}}) AS b, max(auc) FILTER (features = 'F0') AS o FROM auc) SELECT CASE WHEN b.auc - o >= 0.03 THEN b.variant ELSE 'F0' END AS variant, round(CASE WHEN b.auc - o >= 0.03 THEN b.auc ELSE o END, 6) AS auc FROM b")
def variant_choice(spark, d):
    """The best variant if it gains enough on the original."""
    return r6(threshold.select_variant(_feature_aucs(spark, d).withColumnRenamed("features", "variant"), "F0"), "auc")


@query(f"WITH {SIGNALS} SELECT round(quantile_cont(pattern, 0.02), 6) AS pattern, round(quantile_cont(sentence, 0.02), 6) AS sentence FROM signals WHERE role = 'train' AND label = 1")
def clear_thresholds(spark, d):
    """Scores under which a stage clears a document (T5)."""
    return r6(report.clear_thresholds(signals(spark, d).where("role = 'train'"), ["pattern", "sentence", "embedding"], 0.02), "pattern", "sentence")


@query(f"""WITH {SIGNALS}, s AS (SELECT label, least(floor(sentence * 1000 + 1e-9), 1000)::INT AS b FROM signals), c AS (SELECT i, count(*) FILTER (label = 1 AND b >= i) AS tp, count(*) FILTER (label = 0 AND b >= i) AS fp, count(*) FILTER (label = 1) AS pos FROM s, range(1, 1000) r(i) GROUP BY i),
f AS (SELECT i, round(2.0::DOUBLE * tp / (tp + fp + pos), 12) AS f1 FROM c) SELECT 'sentence' AS method, i / 1000.0::DOUBLE AS thr, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, i LIMIT 1""")
def fine_grid(spark, d):
    """The first best of a thousand cuts, equal to twelve digits."""
    s = signals(spark, d).select(F.lit("sentence").alias("method"), "label", F.col("sentence").alias("score"))
    return r6(threshold.grid_sweep(s, 1000), "f1")


@query(f"""WITH {SIGNALS}, t AS (SELECT quantile_cont(embedding, 0.95) AS e, quantile_cont(sentence, 0.95) AS s FROM signals WHERE label = 0), r AS (SELECT attack_type, avg((embedding > e)::INT) AS control, avg((sentence > s)::INT) AS classifier FROM signals, t WHERE label = 1 GROUP BY attack_type)
SELECT attack_type, round(control, 6) AS control, round(classifier, 6) AS classifier, CASE WHEN classifier = 0 THEN 'no detection' WHEN round(control / classifier, 9) >= 0.8 THEN 'generator style' ELSE 'instructions' END AS reads FROM r""")
def generator_style(spark, d):
    """Whether a control's recall comes near the classifier's, per attack."""
    s = signals(spark, d)
    thr = wide_quantiles(s.where("label = 0"), ["embedding", "sentence"], [0.95]).select(F.col("embedding")[0].alias("e"), F.col("sentence")[0].alias("c"))
    rows = s.where("label = 1").join(F.broadcast(thr)).groupBy("attack_type").agg(F.avg((F.col("embedding") > F.col("e")).cast("int")).alias("control"), F.avg((F.col("sentence") > F.col("c")).cast("int")).alias("classifier"))
    return r6(rows.withColumn("reads", report.generator_style(F.col("control"), F.col("classifier"))), "control", "classifier")


@query(f"""WITH {SIGNALS}, v AS (SELECT attack_type, pattern > 0.65 AS p, sentence > 0.6 AS s, embedding > 0.7 AS e FROM signals) SELECT attack_type, count(*) AS n, count(*) FILTER (p AND NOT s AND NOT e) AS only_pattern, count(*) FILTER (s AND NOT p AND NOT e) AS only_sentence, count(*) FILTER (e AND NOT p AND NOT s) AS only_embedding FROM v GROUP BY attack_type""")
def stage_solo_hits(spark, d):
    """Documents that one stage alone catches, per category."""
    p, s, e = F.col("pattern") > 0.65, F.col("sentence") > 0.6, F.col("embedding") > 0.7
    return signals(spark, d).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(p & ~s & ~e).alias("only_pattern"), F.count_if(s & ~p & ~e).alias("only_sentence"), F.count_if(e & ~p & ~s).alias("only_embedding"))


@query(f"""WITH {SIGNALS}, m AS (SELECT regexp_extract(meta, 'position=([^|]*)', 1) AS position, attack_type, sentence > 0.6 AS f FROM signals WHERE label = 1) SELECT position, attack_type, count(*) AS n, round(avg(f::INT), 6) AS recall FROM m GROUP BY GROUPING SETS ((position), (attack_type), (position, attack_type))""")
def transfer_by_attack(spark, d):
    """Recall by position, attack and both, with one threshold."""
    rows = signals(spark, d).where("label = 1").select(F.regexp_extract("meta", r"position=([^|]*)", 1).alias("position"), "attack_type", (F.col("sentence") > 0.6).cast("int").alias("f"))
    out = rows.groupingSets([["position"], ["attack_type"], ["position", "attack_type"]], "position", "attack_type").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("recall"))
    return r6(out, "recall")


@query(f"""WITH {SIGNALS}, n AS (SELECT label, (pattern + embedding + perplexity) / 3 AS naive, pattern, embedding, perplexity, sentence FROM signals),
r AS (SELECT unnest(['naive', 'pattern', 'embedding', 'perplexity', 'sentence']) AS method, unnest([naive, pattern, embedding, perplexity, sentence]) AS score, label FROM n),
s AS (SELECT method, label, least(floor(score * 20 + 1e-9), 20)::INT AS b FROM r), c AS (SELECT method, i, count(*) FILTER (label = 1 AND b >= i) AS tp, count(*) FILTER (label = 0 AND b >= i) AS fp, count(*) FILTER (label = 1) AS pos FROM s, range(1, 20) g(i) GROUP BY ALL),
f AS (SELECT method, i, round(2.0::DOUBLE * tp / (tp + fp + pos), 12) AS f1 FROM c), x AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, i) AS k, count(*) FILTER (true) OVER (PARTITION BY method) AS cuts, max(f1) OVER (PARTITION BY method) AS top FROM f)
SELECT method, max(i) FILTER (k = 1) / 20.0::DOUBLE AS thr, round(max(f1), 6) AS f1, count(*) FILTER (round(top - f1, 9) < 0.01) AS near FROM x GROUP BY method""")
def development_table(spark, d):
    """Best grid F1 of every method and how many cuts come within 0.01 of it: few are a knife edge."""
    s = signals(spark, d).withColumn("naive", (F.col("pattern") + F.col("embedding") + F.col("perplexity")) / 3)
    rows = threshold.long_scores(s, ["naive", *METHODS], ["label"])
    cuts = threshold.grid_f1(rows)
    top = cuts.groupBy("method").agg(F.max("f1").alias("top"))
    best = threshold.grid_sweep(rows)
    near = cuts.join(top, "method").groupBy("method").agg(F.count_if(F.round(F.col("top") - F.col("f1"), 9) < 0.01).alias("near"))
    return r6(best.join(near, "method"), "f1")
