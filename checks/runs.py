"""Run selection, look-ups and metric histories."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fablework.functions import cosine_schedule, plain_string, scientific_string
from fablework.operators import history as hist
from fablework.operators import predicates, runs
from fablework.plans import recipes
from fablework.session import fresh_path
from fablework.sources import readers
from fablework.sources.sample_tables import deletion_models, history, probe_logits, table
from fablework.sources.sample_tables import runs as run_table

from . import sql
from .scoring import _rounded

TYPES = runs.training_types()
CHOSEN = (0, 30, 270, 600)
SCALARS = ["run_id", "name", "state", "learning_rate", "dataset_name", "model_dir", "lr_scheduling", "final_loss"]


def _models(spark, folder):
    typed = runs.with_training_type(
        deletion_models(spark, folder).withColumnRenamed("deletion_dataset", "dataset_name"), TYPES, name="deletion_type"
    )
    return typed.select("model", "deletion_type", "deletion_lr")


def _typed_runs(table, tags):
    """Finished runs with all ``tags`` at the wanted rates, with their types."""
    return (
        table.transform(runs.finished_runs)
        .transform(runs.without_rates, "learning_rate")
        .transform(predicates.with_all_tags, tags)
        .transform(runs.with_training_type, TYPES)
    )


def _studied(spark, folder):
    return (
        _typed_runs(run_table(spark, folder), ["exp2"])
        .transform(runs.with_deletion_info, _models(spark, folder))
        .transform(runs.without_rates, "deletion_lr")
        .transform(runs.of_types, "training_type")
        .transform(runs.of_types, "deletion_type")
    )


def runs_view(spark, folder):
    return _rounded(run_table(spark, folder).select(*SCALARS, F.array_join("tags", ",").alias("tags")))


def runs_read(spark, folder):
    """A written run table read back by tag; the losses of some runs are NaN there."""
    path = fresh_path(spark, "runs")
    loss = F.when(F.col("run_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("final_loss"))
    run_table(spark, folder).withColumn("final_loss", loss).write.parquet(path)
    found, nothing = readers.read_runs(spark, path, tag="exp2")
    assert nothing is None
    return _rounded(found.select("run_id", "state", "final_loss"))


def runs_filtered(spark, folder):
    kept = _typed_runs(run_table(spark, folder), ["exp2", "deletion"]).transform(runs.of_types, "training_type")
    return kept.select("run_id", "state", "learning_rate", "training_type")


def runs_scheduled(spark, folder):
    return run_table(spark, folder).filter(F.col("lr_scheduling").isNotNull()).select("run_id")


def runs_tagged(spark, folder):
    return predicates.with_all_tags(run_table(spark, folder), ["recovery", "exp2"]).select("run_id")


def deletion_info(spark, folder):
    return _studied(spark, folder).select("run_id", "model", "training_type", "deletion_type", "deletion_lr")


def baseline_replicated(spark, folder):
    copies = runs.replicate_baselines(_studied(spark, folder), ["Filtering"], [1e-5, 1e-4])
    return copies.select("run_id", "deletion_type", "deletion_lr")


def model_dir(spark, folder):
    return run_table(spark, folder).select("run_id", runs.model_name(F.col("model_dir")).alias("model"))


def shown_type(spark, folder):
    u = F.col("run_id") % 2 == 0
    name = F.when(u, F.lit("Filtering + 100% Adversarial Training")).otherwise(F.lit("Filtering"))
    return run_table(spark, folder).select("run_id", runs.shown_type(name).alias("kind"))


def _specs(spark, folder):
    even = F.col("run_id") % 2 == 0
    option = lambda c: F.when(even, c)
    return run_table(spark, folder).select(
        "run_id",
        recipes.dataset_name_column(
            filtering=F.concat(F.lit("features!="), F.col("state"), F.lit(",length=100")),
            mix_match=option(F.concat(F.lit("features:"), F.col("dataset_name"), F.lit("=Twist"))),
            adversarial_training=option(F.lit("features=Twist:0.5")),
        ).alias("spec"),
    )


def dataset_name(spark, folder):
    return _specs(spark, folder)


def dataset_name_parts(spark, folder):
    parts = runs.parse_dataset_name(F.col("spec"))
    return _specs(spark, folder).select("run_id", *[c.alias(n) for n, c in parts.items()])


def rate_strings(spark, folder):
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    value = table(spark, folder, "events").select("event_id", F.concat(cents, F.lit("E-7")).cast("double").alias("x"))
    return value.select("event_id", plain_string(F.col("x")).alias("plain"), scientific_string(F.col("x")).alias("scientific"))


def run_name_lines(spark, folder):
    return runs.run_name_lines(run_table(spark, folder), [1e-3, 1e-5], "/cache/")


def sweep_grid(spark, folder):
    datasets = run_table(spark, folder).select("dataset_name").distinct()
    return runs.sweep_grid(datasets, learning_rate=[1e-3, 1e-4, 1e-5], seed=[1, 2])


def model_lineage(spark, folder):
    found = run_table(spark, folder)
    deletions = found.select(F.col("name").alias("model"), F.col("learning_rate").alias("deletion_lr"))
    recoveries = found.select(
        F.col("name").alias("recovery"), F.concat(F.regexp_extract("model_dir", "([^/]*)/out", 1), F.lit("/out")).alias("source")
    )
    return runs.model_lineage(deletions, recoveries).select("recovery", "model", "deletion_lr")


def history_view(spark, folder):
    return _rounded(history(spark, folder))


def history_enriched(spark, folder):
    known = run_table(spark, folder).withColumn("loss_test", F.lit(-1.0)).select("run_id", "name", "dataset_name", "loss_test")
    return _rounded(hist.enrich(history(spark, folder), known).drop("clock_us"))


def history_thinned(spark, folder):
    return hist.thinned(history(spark, folder), 300, 300).select("run_id", "iter")


def smooth_history(spark, folder):
    return _rounded(hist.smoothed(history(spark, folder), "gen_score").select("run_id", "iter", "gen_score_smooth"))


def smooth_last_evals(spark, folder):
    last = hist.last_evals(history(spark, folder), "gen_score")
    return _rounded(hist.smoothed(last, "gen_score", 1.5).select("run_id", "iter", "gen_score_smooth"))


def last_n_evals(spark, folder):
    return hist.last_evals(history(spark, folder), "gen_score").select("run_id", "iter")


def ema(spark, folder):
    # the tiny shift keeps exact decimal ties from rounding either way
    found = hist.moving_average(history(spark, folder), "loss_test")
    return found.select("run_id", "iter", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


def running_best(spark, folder):
    found = hist.running_best(history(spark, folder), "loss_test")
    return _rounded(found.select("run_id", "iter", "best_before", "improved"))


def step_time(spark, folder):
    return hist.step_time(history(spark, folder), "clock_us").select("run_id", "iter", "step_time")


def distinct_evals(spark, folder):
    return hist.distinct_evals(history(spark, folder))


def derived_columns(spark, folder):
    return _rounded(
        hist.derived(history(spark, folder), "loss_test", 0.25, 1, 131072).select(
            "run_id", "iter", "log_loss_test", "loss_test_baseline", "shifted", "tokens"
        )
    )


def lr_schedule(spark, folder):
    rate = cosine_schedule(F.col("iter"), 5e-4, 100, 600)
    return history(spark, folder).select("run_id", "iter", F.round(rate * 1e3, 6).alias("lr_milli"))


def _typed_history(spark, folder):
    studied = _studied(spark, folder)
    return hist.enrich(history(spark, folder), studied.select("run_id", "deletion_type", "deletion_lr"))


def score_pivot(spark, folder):
    key = runs.score_key(F.col("deletion_type"), F.col("deletion_lr"))
    return _rounded(hist.score_pivot(_typed_history(spark, folder), key, CHOSEN, "gen_score"))


def score_table_lines(spark, folder):
    key = runs.score_key(F.col("deletion_type"), F.col("deletion_lr"))
    pivot = _rounded(hist.score_pivot(_typed_history(spark, folder), key, CHOSEN, "gen_score"))
    return runs.table_lines(pivot, "key", [f"at_{i}" for i in CHOSEN])


def chosen_scores(spark, folder):
    return _rounded(hist.chosen_scores(history(spark, folder), CHOSEN, "gen_score").drop("clock_us"))


def loss_by_type(spark, folder):
    curve = hist.mean_curve(_typed_history(spark, folder), ["deletion_lr", "deletion_type", "iter"], "loss_test")
    return _rounded(curve.withColumn("mean", F.col("mean") + 1e-9))  # off exact decimal ties


def loss_bands(spark, folder):
    """The loss curve of each kind of run with the band of 50 replicates."""
    rows = _typed_history(spark, folder).withColumn("stage", F.floor(F.col("iter") / 100).cast("bigint"))
    bands = hist.mean_bands(rows, ["deletion_type", "stage"], "loss_test", ["run_id", "iter"], replicates=50, seed=4)
    return bands.select("deletion_type", "stage", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "low", "high")])


def renamed_losses(spark, folder):
    wide = history(spark, folder).select("run_id", "iter", F.col("loss_test").alias("loss/specialise-Twist"))
    return _rounded(runs.renamed(wide, runs.loss_names()))


def probe_columns(spark, folder):
    right = ((F.col("logit") > 0).cast("int") == F.col("target")).cast("double")
    layers = list(range(11))
    wide = probe_logits(spark, folder).groupBy("feature").agg(
        *[F.avg(F.when(F.col("layer") == i, right)).alias(f"acc/test/probe_{i}") for i in layers]
    )
    long = hist.unpivot_probes(wide, ["feature"], [f"acc/test/probe_{i}" for i in layers])
    return _rounded(long.filter(F.col("probe_accuracy").isNotNull()))  # the last layer has four features


def runs_sorted(spark, folder):
    return run_table(spark, folder).orderBy("dataset_name", F.desc("learning_rate"), "run_id").select("run_id", "dataset_name")


QUERIES = {
    f.__name__: f
    for f in (
        runs_view, runs_read, runs_filtered, runs_scheduled, runs_tagged, deletion_info, baseline_replicated, model_dir, shown_type,
        dataset_name, dataset_name_parts, rate_strings, run_name_lines, sweep_grid, model_lineage, history_view,
        history_enriched, history_thinned, smooth_history, smooth_last_evals, last_n_evals, ema, running_best, step_time,
        distinct_evals, derived_columns, lr_schedule, score_pivot, score_table_lines, chosen_scores, loss_by_type, loss_bands,
        renamed_losses, probe_columns, runs_sorted,
    )
}

# ------------------------------------------------------------------ oracle SQL

H = sql.with_views(sql.HISTORY)
R = sql.with_views(sql.RUNS)

_TYPE = """CASE dataset_name WHEN 'filter-Twist' THEN 'Filtering' WHEN 'filter-adv-Twist' THEN 'Filtering + Adversarial Training'
 WHEN 'filter-mix-Twist-Foreshadowing' THEN 'Filtering + Mix & Match' WHEN 'specialise-Twist' THEN 'Recovery' END"""
_STUDIED = f"""studied AS (SELECT r.run_id, r.name, r.state, r.training_type, m.name model, m.training_type deletion_type, m.learning_rate deletion_lr
 FROM (SELECT *, {_TYPE} training_type, regexp_extract(model_dir, '(base91M-[^/]*)/', 1) model FROM runs) r
 JOIN (SELECT *, {_TYPE} training_type FROM runs) m ON r.model=m.name
 WHERE r.state NOT IN ('failed','crashed') AND r.learning_rate NOT IN (0.01, 0.001) AND m.learning_rate NOT IN (0.01, 0.001))"""
_SPEC = """replace(replace(replace(replace(replace(concat('F_features!=', state, ',length=100_MM_',
 CASE WHEN run_id%2=0 THEN concat('features:', dataset_name, '=Twist') ELSE 'None' END, '_AT_',
 CASE WHEN run_id%2=0 THEN 'features=Twist:0.5' ELSE 'None' END, '_RF_None_IS_None'),
 'None','none'),'!=','_x_'),'=','_'),',','_'),':','_')"""
_SPEC_PATTERN = "'^F_(.*?)_MM_(.*?)_AT_(.*?)_RF_(.*?)_IS_(.*)$'"


def _smooth(source: str, sigma: float) -> str:
    r = math.floor(4 * sigma + 0.5)
    weight = f"exp(-0.5*(k/{sigma!r})**2)"
    return f"""s AS (SELECT run_id, iter, gen_score, row_number() OVER (PARTITION BY run_id ORDER BY iter)-1 i,
  count(*) OVER (PARTITION BY run_id) n FROM {source} WHERE gen_score IS NOT NULL),
k AS (SELECT k, {weight}/sum({weight}) OVER () wt FROM (SELECT unnest(range(-{r},{r}+1)) k) q),
j AS (SELECT run_id, iter, wt, n, ((i+k)%(2*n)+2*n)%(2*n) q FROM s, k)
SELECT j.run_id, j.iter, round(sum(CAST(wt AS DOUBLE)*s.gen_score),6) gen_score_smooth FROM j
 JOIN s ON s.run_id=j.run_id AND s.i=CASE WHEN q<j.n THEN q ELSE 2*j.n-1-q END GROUP BY j.run_id, j.iter"""


_LAST = """evals AS (SELECT run_id, count(DISTINCT iter_num_gen) evals FROM history GROUP BY run_id),
last AS (SELECT h.* FROM history h JOIN evals e ON h.run_id=e.run_id WHERE iter_num_gen IS NOT NULL AND gen_score IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY h.run_id ORDER BY iter DESC) <= evals)"""
_TYPED = """typed AS (SELECT h.*, deletion_type, deletion_lr FROM history h JOIN studied s ON h.run_id=s.run_id)"""
_KEY = """concat(CASE deletion_type WHEN 'Filtering' THEN 'F' WHEN 'Filtering + Adversarial Training' THEN 'F+AT'
 WHEN 'Filtering + Mix & Match' THEN 'F+MM' ELSE deletion_type END, '; LR ', CASE deletion_lr WHEN 1e-5 THEN '1e-5' ELSE '1e-4' END)"""
_PIVOT = f"""per_run AS (SELECT {_KEY} "key", run_id,
 {', '.join(f'round(max(gen_score) FILTER (iter_num_gen={i} AND NOT isnan(gen_score)),6) at_{i}' for i in CHOSEN)} FROM typed GROUP BY 1, 2),
pivoted AS (SELECT * EXCLUDE (run_id) FROM per_run QUALIFY row_number() OVER (PARTITION BY "key" ORDER BY run_id DESC) = 1)"""
_CELLS = ", ".join(f"CASE WHEN at_{i} IS NOT NULL THEN printf('%.2f', round(at_{i},2)) END" for i in CHOSEN)

SQL = {
    "runs_view": R
    + """SELECT run_id, "name", state, round(learning_rate,6) learning_rate, dataset_name, model_dir, lr_scheduling,
 round(final_loss,6) final_loss, array_to_string(tags,',') tags FROM runs""",
    "runs_read": R
    + """SELECT run_id, state, CASE WHEN run_id%7<>0 THEN round(final_loss,6) END final_loss FROM runs
 WHERE list_contains(tags,'exp2')""",
    "runs_filtered": R
    + f"""SELECT run_id, state, learning_rate, {_TYPE} training_type FROM runs WHERE state NOT IN ('failed','crashed')
 AND learning_rate NOT IN (0.01, 0.001) AND list_contains(tags,'deletion') AND list_contains(tags,'exp2')""",
    "runs_scheduled": R + "SELECT run_id FROM runs WHERE lr_scheduling IS NOT NULL",
    "runs_tagged": R + "SELECT run_id FROM runs WHERE list_contains(tags,'recovery') AND list_contains(tags,'exp2')",
    "deletion_info": sql.with_views(sql.RUNS, _STUDIED)
    + "SELECT run_id, model, training_type, deletion_type, deletion_lr FROM studied",
    "baseline_replicated": sql.with_views(sql.RUNS, _STUDIED)
    + """SELECT run_id, deletion_type, deletion_lr FROM studied WHERE deletion_type <> 'Filtering' UNION ALL
 SELECT run_id, deletion_type, CAST(unnest([1e-5, 1e-4]) AS DOUBLE) FROM
 (SELECT * FROM studied WHERE deletion_type='Filtering' ORDER BY "name" LIMIT 1) q""",
    "model_dir": R + "SELECT run_id, regexp_extract(model_dir, '(base91M-[^/]*)/', 1) model FROM runs",
    "shown_type": R
    + "SELECT run_id, CASE WHEN run_id%2=0 THEN 'Filtering + Adversarial Training' ELSE 'Filtering' END kind FROM runs",
    "dataset_name": R + f"SELECT run_id, {_SPEC} spec FROM runs",
    "dataset_name_parts": R
    + "SELECT run_id, "
    + ", ".join(
        f"regexp_extract(spec, {_SPEC_PATTERN}, {i + 1}) {n}"
        for i, n in enumerate(("filtering", "mix_match", "adv_training", "refusal", "instruction_subset"))
    )
    + f" FROM (SELECT run_id, {_SPEC} spec FROM runs) q",
    "rate_strings": """WITH d AS (SELECT event_id, CAST(round(value*100) AS BIGINT) n FROM events)
 SELECT event_id, CASE WHEN n=0 THEN '0.0' ELSE concat('0.', rtrim(lpad(CAST(n AS VARCHAR),7,'0'),'0')) END "plain",
 CASE WHEN n=0 THEN '0e0' ELSE concat(rtrim(rtrim(concat(substr(CAST(n AS VARCHAR),1,1),'.',substr(CAST(n AS VARCHAR),2)),'0'),'.'),
 'e', CAST(length(CAST(n AS VARCHAR))-8 AS VARCHAR)) END scientific FROM d""",
    "run_name_lines": R + """SELECT concat('  - /cache/', "name", '/out') line FROM runs WHERE learning_rate IN (1e-3, 1e-5)""",
    "sweep_grid": R
    + """SELECT dataset_name, CAST(l AS DOUBLE) learning_rate, CAST(s AS INTEGER) seed FROM (SELECT DISTINCT dataset_name FROM runs) d,
 (SELECT unnest([1e-3,1e-4,1e-5]) l) x, (SELECT unnest([1,2]) s) y""",
    "model_lineage": R
    + """SELECT r."name" recovery, m."name" model, m.learning_rate deletion_lr FROM runs r
 JOIN runs m ON regexp_extract(r.model_dir, '([^/]*)/out', 1)=m."name" """,
    "history_view": H
    + """SELECT run_id, iter, round(loss_test,6) loss_test, iter_num_gen, round(gen_score,6) gen_score, clock_us FROM history""",
    "history_enriched": sql.with_views(sql.HISTORY, sql.RUNS)
    + """SELECT h.run_id, iter, round(loss_test,6) loss_test, iter_num_gen, round(gen_score,6) gen_score, "name", dataset_name
 FROM history h JOIN runs r ON h.run_id=r.run_id""",
    "history_thinned": H + "SELECT run_id, iter FROM history WHERE iter % (CASE WHEN iter<300 THEN 30 ELSE 300 END) = 0",
    "smooth_history": sql.with_views(sql.HISTORY, _smooth("history", 2.0)),
    "smooth_last_evals": sql.with_views(sql.HISTORY, _LAST, _smooth("last", 1.5)),
    "last_n_evals": sql.with_views(sql.HISTORY, _LAST) + "SELECT run_id, iter FROM last",
    "ema": H
    + """SELECT run_id, iter, round(list_reduce(xs[6:i], lambda a, x: 0.9*a+(1.0-0.9)*x)+1e-9,6) ema
 FROM (SELECT run_id, iter, list(loss_test) OVER (PARTITION BY run_id ORDER BY iter) xs,
 row_number() OVER (PARTITION BY run_id ORDER BY iter) i FROM history) q WHERE i > 5""",
    "running_best": H
    + """SELECT run_id, iter, round(b,6) best_before, b IS NULL OR loss_test < b improved FROM
 (SELECT *, min(loss_test) OVER (PARTITION BY run_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM history) q""",
    "step_time": H + "SELECT run_id, iter, clock_us - lag(clock_us) OVER (PARTITION BY run_id ORDER BY iter) step_time FROM history",
    "distinct_evals": H + "SELECT run_id, CAST(count(DISTINCT iter_num_gen) AS BIGINT) evals FROM history GROUP BY run_id",
    "derived_columns": H
    + """SELECT run_id, iter, CASE WHEN loss_test>0 THEN round(ln(CASE WHEN loss_test>0 THEN loss_test ELSE 1 END),6) END log_loss_test, round(loss_test-0.25,6) loss_test_baseline, iter+1 shifted,
 iter*131072 tokens FROM history""",
    "lr_schedule": H
    + """SELECT run_id, iter, round(1e3*CAST(CASE WHEN iter<100 THEN 5e-4*iter/100 WHEN iter>600 THEN 0
 ELSE 0.5*(1+cos(pi()*(iter-100)/500.0))*5e-4 END AS DOUBLE),6) lr_milli FROM history""",
    "score_pivot": sql.with_views(sql.RUNS, sql.HISTORY, _STUDIED, _TYPED, _PIVOT) + "SELECT * FROM pivoted",
    "score_table_lines": sql.with_views(sql.RUNS, sql.HISTORY, _STUDIED, _TYPED, _PIVOT)
    + f"""SELECT concat_ws(' & ', "key", {_CELLS}) || ' \\\\' line FROM pivoted""",
    "chosen_scores": H
    + f"""SELECT run_id, iter, round(loss_test,6) loss_test, iter_num_gen, round(gen_score,6) gen_score FROM history
 WHERE iter_num_gen IN {CHOSEN} AND gen_score IS NOT NULL""",
    "loss_by_type": sql.with_views(sql.RUNS, sql.HISTORY, _STUDIED, _TYPED)
    + """SELECT round(deletion_lr,6) deletion_lr, deletion_type, iter, round(avg(loss_test)+1e-9,6) mean, CAST(count(loss_test) AS BIGINT) n
 FROM typed GROUP BY 1, 2, 3""",
    "loss_bands": sql.with_views(sql.RUNS, sql.HISTORY, _STUDIED, _TYPED)
    + f"""SELECT m.deletion_type, m.stage, n, round("mean"+1e-9,6) "mean", round("low"+1e-9,6) "low", round("high"+1e-9,6) "high" FROM
 (SELECT deletion_type, iter//100 stage, avg(loss_test) "mean", CAST(count(loss_test) AS BIGINT) n FROM typed WHERE loss_test IS NOT NULL GROUP BY 1, 2) m
 JOIN (SELECT deletion_type, stage, quantile_cont(s/k, 0.025) "low", quantile_cont(s/k, 0.975) "high" FROM
  (SELECT deletion_type, stage, b, sum(w*loss_test) s, nullif(sum(w),0) k FROM
   (SELECT deletion_type, iter//100 stage, loss_test, b, len(list_filter({list(hist.POISSON)}, lambda c: u >= c)) w FROM
    (SELECT *, {sql.u01(4, 'band', "(run_id||'|'||iter||'|'||b)")} u FROM typed, (SELECT unnest(range(1,51)) b) WHERE loss_test IS NOT NULL))
   GROUP BY 1, 2, 3) GROUP BY 1, 2) p ON p.deletion_type IS NOT DISTINCT FROM m.deletion_type AND p.stage=m.stage""",
    "renamed_losses": H + 'SELECT run_id, iter, round(loss_test,6) "Task Loss" FROM history',
    "probe_columns": sql.with_views(sql.PROBES)
    + """SELECT feature, layer probe_index, round(avg(CASE WHEN (logit>0)=(target=1) THEN 1.0 ELSE 0.0 END),6) probe_accuracy
 FROM probe_logits GROUP BY 1, 2""",
    "runs_sorted": R + "SELECT run_id, dataset_name FROM runs",
}
