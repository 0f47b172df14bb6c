"""Further queries of the catalogue: reports and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelight.functions import fusion, text as T
from sievelight.operators import bootstrap, cascade, inject, learn, metrics, neighbours, sentence, similarity, split, threshold, windows
from sievelight.operators.ordered import wide_quantiles
from sievelight.plans.base import POOL, SCALE, SIGNALS, draw_sql, pool, scores, signals, table, written, written_part
from sievelight.plans.catalog import LEVELS, METRICS_SQL, MS, SIM, SPLITS, STAGES, _vectors, query, r6, rates_sql
from sievelight.schema import draw, source_group
from sievelight.sources import readers


@query(rf"""WITH {SIGNALS}, wrong AS (SELECT id, source, CASE WHEN label = 0 THEN 'false alarm' ELSE 'miss' END AS error FROM signals WHERE (label = 0) = (sentence > 0.55)),
chosen AS (SELECT id, source, error FROM (SELECT *, row_number() OVER (PARTITION BY error, source ORDER BY md5('42|' || id), id) AS r FROM wrong) WHERE error = 'false alarm' OR r <= 5),
e0 AS (SELECT chosen.id, chosen.source, error, text, list_filter(flatten(list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')))), lambda s: s <> '') AS u FROM chosen JOIN pool USING (id)),
e1 AS (SELECT id, source, error, unnest(CASE WHEN len(u) = 0 THEN [text] ELSE u END) AS s, unnest(range(CASE WHEN len(u) = 0 THEN 1 ELSE len(u) END)) AS pos FROM e0),
e2 AS (SELECT *, (right(s, 1) = '?')::INT + regexp_matches(lower(s), '\b(you|your)\b')::INT + regexp_matches(lower(s), '\b(please|ensure|make sure|must|should|kindly|do not|don''t)\b')::INT + regexp_matches(lower(s), '\b(response|answer|reply|output|implementation)\b')::INT + contains(s, '```')::INT AS score FROM e1)
SELECT id, source, error, arg_max(md5(s), (score, -pos)) AS sentence, max(score) AS score FROM e2 GROUP BY ALL""")
def error_report(spark, d):
    """Every false alarm and five misses of each source, each with the one of all its sentences that asks most of its reader."""
    wrong = neighbours.error_rows(signals(spark, d).withColumn("score", F.col("sentence")), 0.55).select("id", "source", "error")
    chosen = wrong.where("error = 'false alarm'").unionByName(split.capped_sample(wrong.where("error = 'miss'"), ["source"], 5).drop("rank"))
    units = pool(spark, d).select("id", "text").join(chosen, "id").select("id", "source", "error", F.posexplode(T.sentence_units(F.col("text"), None)).alias("pos", "unit"))
    hand = T.hand_features(F.col("unit"))
    asks = sum((hand[k].cast("int") for k in ("question", "you", "modal", "output", "fence")), F.lit(0))
    best = F.max(F.struct(asks.alias("score"), (-F.col("pos")).alias("first"), F.md5("unit").alias("sentence"))).alias("b")
    return units.groupBy("id", "source", "error").agg(best).select("id", "source", "error", "b.sentence", "b.score")


@query("""WITH d AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, (n >= 10)::INT AS reached FROM d""")
def dataset_counts(spark, d):
    """Files per category against a target."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("reached", (F.col("n") >= 10).cast("int"))


@query("SELECT doc_id, md5(substr(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 200)) AS shown FROM documents")
def display_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clipped_display(F.col("text"))).alias("shown"))


@query("""WITH n AS (SELECT CASE doc_id % 4 WHEN 0 THEN upper(source) || '_Classifier' WHEN 1 THEN '  ' || source || ' - ' || lang || ' bank' WHEN 2 THEN source || '__detector ' ELSE source END AS name FROM documents)
SELECT regexp_replace(regexp_replace(lower(trim(name)), '[\\s_\\-]+', ' ', 'g'), ' (classifier|bank|detector)$', '') AS stage, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY 1""")
def stage_alias(spark, d):
    """Detector names as files of measured times may write them, one per document, and the stage that they mean."""
    form, source = F.col("doc_id") % 4, F.col("source")
    name = F.when(form == 0, F.concat(F.upper(source), F.lit("_Classifier"))).when(form == 1, F.concat(F.lit("  "), source, F.lit(" - "), "lang", F.lit(" bank"))).when(form == 2, F.concat(source, F.lit("__detector "))).otherwise(source)
    named = table(spark, d, "documents").select(name.alias("name"))
    return named.groupBy(windows.stage_name(F.col("name")).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query(f"WITH {SIGNALS} SELECT id, round(greatest(least((embedding - 0.5) * 40, 10), -10) / 10, 6) AS squashed, round((pattern + embedding + perplexity) / 3, 6) AS naive FROM signals")
def score_squash(spark, d):
    s = signals(spark, d)
    return s.select("id", F.round(fusion.squash((F.col("embedding") - 0.5) * 40), 6).alias("squashed"), F.round((F.col("pattern") + F.col("embedding") + F.col("perplexity")) / 3, 6).alias("naive"))


@query(f"WITH {SIGNALS} SELECT CASE WHEN source LIKE 'pds%' THEN 'pds' ELSE source END AS grp, label, round(avg((sentence >= 0.5)::INT), 6) AS flagged, count(*) AS n FROM signals GROUP BY 1, 2")
def evasion_rates(spark, d):
    return signals(spark, d).groupBy(source_group(F.col("source")).alias("grp"), "label").agg(F.round(F.avg((F.col("sentence") >= 0.5).cast("int")), 6).alias("flagged"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIGNALS} SELECT id, source, sentence FROM signals WHERE label = 1 AND sentence < 0.5")
def remaining_misses(spark, d):
    return signals(spark, d).where("label = 1 and sentence < 0.5").select("id", "source", "sentence")


@query(f"WITH {SIGNALS}, m AS (SELECT avg(perplexity) FILTER (label = 0) AS a, avg(perplexity) FILTER (label = 1) AS b FROM signals) SELECT round(a, 6) AS clean_mean, round(b, 6) AS garbled_mean, (b - a > 0.3) AS passed FROM m")
def perplexity_category_check(spark, d):
    m = signals(spark, d).agg(F.avg(F.when(F.col("label") == 0, F.col("perplexity"))).alias("a"), F.avg(F.when(F.col("label") == 1, F.col("perplexity"))).alias("b"))
    return m.select(F.round("a", 6).alias("clean_mean"), F.round("b", 6).alias("garbled_mean"), (F.col("b") - F.col("a") > 0.3).alias("passed"))


@query(f"""WITH {SIGNALS}, v AS (SELECT label, pattern > 0.65 AS p, sentence > 0.6 AS s, embedding > 0.7 AS e FROM signals), c AS (
SELECT 'all stages' AS design, {rates_sql('(p OR s OR e)', '')} FROM v UNION ALL SELECT 'without the last', {rates_sql('(p OR s)', '')} FROM v UNION ALL SELECT 'only the last', {rates_sql('(e AND NOT p AND NOT s)', '')} FROM v)
SELECT design, tp, fp, fn, tn, {METRICS_SQL} FROM c""")
def stage_ablation(spark, d):
    p, s, e = F.col("pattern") > 0.65, F.col("sentence") > 0.6, F.col("embedding") > 0.7
    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, ["all stages", "without the last", "only the last"])), F.array(p | s | e, p | s, e & ~p & ~s))).alias("design", "flag")
    return r6(threshold.confusion(signals(spark, d).select("label", each), ["design"]), "precision", "recall", "f1", "fpr")


@query(f"""WITH {SIM}, m AS (SELECT id, max(s) AS s FROM sim GROUP BY id), a AS (SELECT id // 5 AS doc, min(id) AS whole, max(greatest(0, least(1, (1 - s) / 2))) AS seg FROM m GROUP BY 1), w AS (SELECT doc, seg, greatest(0, least(1, (1 - s) / 2)) AS score FROM a JOIN m ON whole = id)
SELECT doc, round(score, 6) AS whole, round(seg, 6) AS segmented, (round(seg - score, 9) > 0.05)::INT AS improved FROM w""")
def whole_vs_segment(spark, d):
    a = similarity.top_similarities(*_vectors(spark, d)).select("id", F.floor(F.col("id") / 5).alias("doc"), fusion.similarity_anomaly(F.col("top")[0]).alias("a"))
    w = a.groupBy("doc").agg(F.min_by("a", "id").alias("whole"), F.max("a").alias("segmented"))
    return r6(w.withColumn("improved", (F.round(F.col("segmented") - F.col("whole"), 9) > 0.05).cast("int")), "whole", "segmented")


@query(f"""WITH {POOL}, b AS (SELECT greatest(40, min(length) - 60) AS lo, max(length) + 120 AS hi FROM pool WHERE label = 1 AND source = 'src1') SELECT doc_id FROM documents, b WHERE length(trim(text, ' ')) BETWEEN lo AND hi""")
def length_band_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return readers.length_band(docs, pool(spark, d).where("label = 1 and source = 'src1'").select("text")).select("doc_id")


@query(f"""WITH {POOL}, w AS (SELECT id, unnest(range(1 + id % 3)) AS win FROM pool), l AS (SELECT id, {draw_sql("'a'", "id", "win")} / 268435456.0::DOUBLE * 4 AS a, {draw_sql("'b'", "id", "win")} / 268435456.0::DOUBLE * 4 AS b, {draw_sql("'c'", "id", "win")} / 268435456.0::DOUBLE * 4 AS c FROM w),
m AS (SELECT id, max(b - ln(exp(a) + exp(c))) AS m, count(*) AS windows FROM l GROUP BY id) SELECT id, round(m, 6) AS margin, windows, round(1 / (1 + exp(-m)), 6) AS probability FROM m""")
def window_margin(spark, d):
    """Largest window margin of a three-class classifier with drawn logits."""
    w = pool(spark, d).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 3)).alias("win"))
    logit = lambda k: draw(F.lit(k), F.col("id").cast("string"), F.col("win").cast("string")) / SCALE * 4
    m = w.withColumn("margin", windows.margin(F.array(logit("a"), logit("b"), logit("c")), windows.injection_label(["safe", "INJECTION", "other"])))
    return r6(windows.document_margins(m), "margin", "probability")


@query("""WITH o AS (SELECT unnest(['Attention:', 'Note to the assistant.', 'Update from support.']) AS o), b AS (SELECT DISTINCT text AS b FROM benchmark WHERE text IS NOT NULL), c AS (SELECT unnest(['', 'Reply with done.', 'Do it now.']) AS c),
t AS (SELECT DISTINCT concat_ws(' ', o, b, nullif(c, '')) AS text FROM o, b, c) SELECT md5(text) AS digest, length(text) AS length FROM t ORDER BY md5('7' || text), text LIMIT 150""")
def attack_templates(spark, d):
    """150 distinct attack texts around the benchmark's items, drawn in hash order."""
    one = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    bodies = table(spark, d, "benchmark").where("text is not null").select(F.col("text").alias("body")).distinct()
    made = inject.templates(one("opener", ["Attention:", "Note to the assistant.", "Update from support."]), bodies, one("closer", ["", "Reply with done.", "Do it now."]), 150, "7")
    return made.select(F.md5("text").alias("digest"), F.length("text").alias("length"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
x AS (SELECT doc_id, w, list_sort(list_transform(range(len(w)), lambda i: {'window': i // 3, 'key': md5('7|' || i || '|' || w[i + 1]), 'word': w[i + 1]})) AS k FROM w),
f AS (SELECT doc_id, list_transform(list_filter(k, lambda y: NOT (lower(y.word) IN ('the', 'of', 'and', 'to', 'a', 'in', 'is', 'that', 'it', 'for') AND y.key[1] < '8')), lambda y: y.word) AS f FROM x),
t AS (SELECT doc_id, upper(f[1][1]) || lower(f[1][2:]) || ' ' || array_to_string(f[2:], ' ') || '.' AS t FROM f)
SELECT doc_id, md5(t) AS digest, len(regexp_extract_all(t, '\S+'))::INT AS n_words FROM t""")
def corrupt_words(spark, d):
    """Word-window corruption."""
    t = T.corrupt(F.col("text"), "7", ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"])
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.size(T.words(F.col("t"))).alias("n_words"))


@query()
def sentence_classifier_auc(spark, d):
    """Fitted on train, scored on val."""
    p = signals(spark, d, text=True).select("id", "text", "label", "role")
    model = sentence.fit(p.where("role = 'train'"))
    s = model.score(p.where("role = 'val'"), ["id", "label"]).select(F.lit("sentence classifier").alias("method"), "label", F.round("score", 9).alias("score"))
    return r6(metrics.roc_auc(s, ["method"]), "auc")


@query()
def honest_f1(spark, d):
    """Mean F1 on documents outside each of a thousand resamples, with a threshold tuned inside it."""
    s = signals(spark, d).select("label", F.col("sentence").alias("score"))
    return bootstrap.out_of_bag_f1(s).agg(F.round(F.avg("f1"), 6).alias("f1"), F.count(F.lit(1)).alias("reps"))



def _design_sql(name: str, q: float | None) -> str:
    """Exit and flag of each validation row: a flag goes before a clear, and the last stage clears nothing."""
    clear = lambda x: f"{x} < (SELECT quantile_cont({x}, {q}) FROM tr WHERE label = 1)" if q is not None else "false"
    return f"""SELECT '{name}' AS design, label, CASE WHEN pattern > t1[u1 + 1] OR {clear('pattern')} THEN 0 WHEN sentence > t2[u2 + 1] OR {clear('sentence')} THEN 1 ELSE 2 END AS x,
CASE WHEN pattern > t1[u1 + 1] THEN true WHEN {clear('pattern')} THEN false WHEN sentence > t2[u2 + 1] THEN true WHEN {clear('sentence')} THEN false ELSE embedding > t3[u3 + 1] END AS flag FROM signals, th, best WHERE role = 'val'"""


@query(f"""WITH {SIGNALS}, tr AS (SELECT * FROM signals WHERE role = 'train'), {SPLITS},
th AS (SELECT quantile_cont(pattern, {LEVELS}) AS t1, quantile_cont(sentence, {LEVELS}) AS t2, quantile_cont(embedding, {LEVELS}) AS t3 FROM tr WHERE label = 0),
f AS (SELECT u1, u2, u3, avg((pattern > t1[u1 + 1] OR sentence > t2[u2 + 1] OR embedding > t3[u3 + 1])::INT) FILTER (label = 1) AS recall, avg((pattern > t1[u1 + 1] OR sentence > t2[u2 + 1] OR embedding > t3[u3 + 1])::INT) FILTER (label = 0) AS fpr FROM tr, th, splits GROUP BY ALL),
best AS (SELECT u1, u2, u3 FROM f ORDER BY recall DESC, fpr, u1 DESC, u2 DESC, u3 DESC LIMIT 1),
sim AS ({' UNION ALL '.join(_design_sql('A' if q is None else f'B {q:.0%}', q) for q in (None, 0.01, 0.02, 0.05))}),
k AS (SELECT design, {rates_sql('flag', '')}, avg([0.12, 1.72, 32.86][x + 1]::DOUBLE) FILTER (label = 0) AS a, avg([0.12, 1.72, 32.86][x + 1]::DOUBLE) FILTER (label = 1) AS b FROM sim GROUP BY design)
SELECT design, round(tp::DOUBLE / (tp + fn), 6) AS tpr, round(fp::DOUBLE / (fp + tn), 6) AS fpr, round(a, 6) AS ms_clean, round(b, 6) AS ms_poisoned, round(0.99 * a + 0.01 * b, 6) AS ms_prev_0_01, round(0.999 * a + 0.001 * b, 6) AS ms_prev_0_001, 32.86::DOUBLE AS ms_all FROM k""")
def cascade_designs(spark, d):
    """A (OR) and B (clear early) at a 5 per cent budget: split, rates and cost on val."""
    s = signals(spark, d)
    train, val, out = s.where("role = 'train'"), s.where("role = 'val'"), None
    best = cascade.choose_split(train, STAGES, 0.05).first()
    thr = cascade.unit_thresholds(train, STAGES, 0.05).first()
    flag = {n: F.lit(thr[f"thr_{n}"][best[f"u{i}"]]) for i, n in enumerate(STAGES, 1)}
    for q in (None, 0.01, 0.02, 0.05):
        clear = None
        if q is not None:
            row = wide_quantiles(train.where("label = 1"), STAGES[:-1], [q]).first()
            clear = {n: F.lit(row[n][0]) for n in STAGES[:-1]}
        sim = cascade.simulate(val, STAGES, flag, clear)
        rate = threshold.confusion(sim, []).select(F.round("recall", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))
        part = rate.crossJoin(cascade.expected_ms(sim, MS)).withColumn("design", F.lit("A" if q is None else f"B {q:.0%}"))  # two one-row tables
        out = part if out is None else out.unionByName(part)
    return r6(out, "ms_clean", "ms_poisoned", "ms_prev_0_01", "ms_prev_0_001", "ms_all")


AUC_SQL = "sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)"


@query(f"""WITH {SIGNALS}, b AS (SELECT min(sentence) AS lo, max(sentence) AS hi FROM signals WHERE role = 'train'),
c AS (SELECT id, source, label, sentence AS score, greatest(0, least(1, (sentence - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END)) AS calibrated, row_number() OVER (PARTITION BY source, label ORDER BY md5('42|' || id), id) AS r FROM signals, b),
s AS (SELECT *, calibrated > 0.5 AS flag FROM c WHERE r <= 60), k AS (SELECT source, {rates_sql('flag', '')} FROM s GROUP BY source),
u AS (SELECT a.source, {AUC_SQL} AS auc FROM s a JOIN s b ON a.source = b.source AND a.label = 1 AND b.label = 0 GROUP BY a.source)
SELECT source, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr, round(auc, 6) AS auc FROM k LEFT JOIN u USING (source)""")
def transfer_report(spark, d):
    """Frozen bounds on a capped sample: recall, false alarms and AUC per source."""
    s = threshold.minmax(scores(spark, d, ("role", "source")).where("method = 'sentence'"))
    sample = split.capped_sample(s, ["source", "label"], 60).withColumn("flag", F.col("calibrated") > 0.5)
    auc = metrics.roc_auc(sample, ["source"])
    return r6(threshold.confusion(sample, ["source"]).join(auc, "source").select("source", "recall", "fpr", "auc"), "recall", "fpr", "auc")


def _adaptation_sql(m: int) -> str:
    return f"""SELECT {m} AS m, round(coalesce(count(*) FILTER (label = 1 AND sentence > thr) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 0), 6) AS tpr, round(coalesce(count(*) FILTER (label = 0 AND sentence > thr) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE, 0), 6) AS fpr
FROM fr, (SELECT coalesce(min(v), 'infinity'::DOUBLE) AS thr FROM (SELECT sentence AS v, row_number() OVER (ORDER BY sentence) AS r, count(*) OVER () AS k FROM fr WHERE label = 0 AND grp IN (SELECT grp FROM dr WHERE before < {m})) WHERE r >= ceil(round((k + 1) * 0.95, 9))) WHERE grp NOT IN (SELECT grp FROM dr WHERE before < {m}) HAVING count(*) > 0"""


@query(f"""WITH {SIGNALS}, fr AS (SELECT * FROM signals WHERE domain = 'fr'), g AS (SELECT grp, count(*) AS n FROM fr WHERE label = 0 GROUP BY grp), dr AS (SELECT grp, sum(n) OVER (ORDER BY md5('42|' || grp), grp) - n AS before FROM g)
{' UNION ALL '.join(map(_adaptation_sql, (20, 40, 60)))}""")
def adaptation_conformal(spark, d):
    """Conformal thresholds of a held-out domain from 20, 40 and 60 of its clean documents, their groups left out."""
    s = signals(spark, d).where("domain = 'fr'")
    out = None
    for m in (20, 40, 60):
        drawn = split.draw_groups(s.where("label = 0"), m).select("group")
        cal = s.where("label = 0").join(drawn, "group", "left_semi").select(F.lit("sentence").alias("method"), "label", F.col("sentence").alias("score"))
        thr = threshold.conformal(cal).select("method", F.lit(0.05).alias("budget"), F.coalesce("thr", F.lit(float("inf"))).alias("thr"))
        rest = s.join(drawn, "group", "left_anti").select(F.lit("sentence").alias("method"), "label", F.col("sentence").alias("score"))
        part = threshold.rates(rest, thr).select(F.lit(m).alias("m"), F.round("recall", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {SIGNALS}, per AS (SELECT source, sentence AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM signals GROUP BY ALL),
c AS (SELECT source, sum(p) OVER d / nullif(sum(p) OVER e, 0)::DOUBLE AS tpr, sum(n) OVER d / nullif(sum(n) OVER e, 0)::DOUBLE AS fpr FROM per WINDOW d AS (PARTITION BY source ORDER BY score DESC), e AS (PARTITION BY source)),
pts AS (SELECT source, fpr, tpr FROM c WHERE tpr IS NOT NULL AND fpr IS NOT NULL UNION ALL SELECT DISTINCT source, 0.0::DOUBLE, 0.0::DOUBLE FROM c WHERE tpr IS NOT NULL AND fpr IS NOT NULL),
g AS (SELECT source, i / 20.0::DOUBLE AS grid, max({{'f': fpr, 't': tpr}}) FILTER (fpr <= i / 20.0::DOUBLE) AS lo, min({{'f': fpr, 'd': -tpr}}) FILTER (fpr >= i / 20.0::DOUBLE) AS hi FROM pts, range(21) r(i) GROUP BY ALL),
v AS (SELECT grid, CASE WHEN hi IS NULL OR hi.f <= lo.f THEN lo.t ELSE lo.t + (-hi.d - lo.t) / (hi.f - lo.f) * (grid - lo.f) END AS v FROM g)
SELECT grid, round(avg(v), 6) AS tpr, count(v) AS curves FROM v GROUP BY grid""")
def roc_mean(spark, d):
    """ROC curves interpolated on a grid and averaged over sources."""
    s = scores(spark, d, ("source",)).where("method = 'sentence'").select(F.col("source").alias("method"), "label", "score")
    curve = metrics.roc_curve(s).where("tpr is not null and fpr is not null")
    return metrics.mean_curve(curve, 20).select("grid", F.round("tpr", 6).alias("tpr"), "curves")


@query()
def style_control(spark, d):
    """Out-of-fold AUC of the standardised style features (L9): what style alone tells."""
    names = list(T.style_features(F.col("text")))
    p = split.stratified_folds(pool(spark, d)).select("id", "fold", F.col("label").cast("double").alias("label"), *(c.alias(k) for k, c in T.style_features(F.col("text")).items()))
    p = written_part(spark, p)
    out = learn.out_of_fold(learn.standardise(p, names, p), names)
    return r6(metrics.roc_auc(out.select(F.lit("style").alias("method"), "label", F.round("score", 9).alias("score")), ["method"]), "auc")


@query(f"""WITH RECURSIVE {POOL}, t AS (SELECT id, length, row_number() OVER (ORDER BY length, id::VARCHAR) AS i FROM pool WHERE label = 1 AND source = 'src0'),
c AS (SELECT list({{'n': length, 'k': id::VARCHAR}} ORDER BY length, id::VARCHAR) AS left_ FROM pool WHERE label = 0 AND source = 'src1'),
f(i, left_, target, matched) AS (
  SELECT 0::BIGINT, left_, NULL::BIGINT, NULL::VARCHAR FROM c UNION ALL
  SELECT i, list_filter(left_, lambda x: x.k <> pick.k), id, pick.k FROM (
    SELECT t.i, f.left_, t.id, list_sort(list_transform(f.left_, lambda x: {{'d': abs(x.n - t.length), 'n': x.n, 'k': x.k}}))[1] AS pick FROM f JOIN t ON t.i = f.i + 1 WHERE len(f.left_) > 0))
SELECT target, matched::BIGINT AS matched FROM f WHERE i > 0""")
def length_match(spark, d):
    """Greedy nearest-length matching of clean documents to the poisoned rows of one source."""
    p = pool(spark, d).where("source in ('src0', 'src1')")
    rows = p.select("id", "label", "length", "source").collect()  # lengths and ids of an evaluation set, no texts
    targets = sorted((r["length"], str(r.id)) for r in rows if r.label == 1 and r.source == "src0")
    found = readers.match_lengths(targets, [(r["length"], str(r.id)) for r in rows if r.label == 0 and r.source == "src1"])
    return spark.createDataFrame([(int(a), int(b)) for a, b in found.items()], "target long, matched long")

