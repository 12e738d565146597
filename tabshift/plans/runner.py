"""Batch runs over conversion cases: discover, convert, clean, score, summarise, write."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.operators.cleanup import cleaned
from tabshift.operators.scoring import scores
from tabshift.plans.convert import Spec
from tabshift.plans.convert import convert as by_spec
from tabshift.sources.files import write_named_files

#: Ranks of case complexity, and of anything else.
COMPLEXITY = {"simple": 0, "medium": 1, "complex": 2}
OTHER_RANK = 99
METRICS = ("format_validity", "schema_compliance", "loadability", "content_accuracy")
META = "use_case string, complexity string, input_format string, output_format string, description string, prompt_hint string, content_accuracy_mode string, required_substrings array<string>"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Cases below root/use_case/case with meta.json, input.* and expected.*; directories that lack one are left out."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("use_case_dir"), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("case"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "value")
    keys = ["use_case_dir", "case"]
    meta = named.filter("file = 'meta.json'").select(*keys, F.from_json("value", META).alias("meta"))
    given = named.filter("file like 'input.%'").select(*keys, F.col("value").alias("input_text"))
    want = named.filter("file like 'expected.%'").select(*keys, F.col("value").alias("expected_text"))
    return meta.join(given, keys).join(want, keys).select(F.concat_ws("/", *keys).alias("case_id"), *keys, "meta.*", "input_text", "expected_text")


def complexity_rank(case: Column) -> Column:
    name = F.split_part(case, F.lit("_"), F.lit(1))
    rank = F.lit(OTHER_RANK)
    for k, v in COMPLEXITY.items():
        rank = F.when(name == k, v).otherwise(rank)
    return rank


def select_cases(cases: DataFrame, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases of use cases whose name holds ``only``, in order, at most ``limit`` (none or 0: all)."""
    chosen = cases.filter(F.col("use_case_dir").contains(only)) if only else cases
    ordered = chosen.orderBy("use_case_dir", complexity_rank(F.col("case")), "case")
    return ordered.limit(limit) if limit else ordered


Converter = Callable[[DataFrame], DataFrame]


def succeeded(raw_output: Column, return_code: Column | None = None) -> Column:
    """Whether a conversion worked: it returned 0 and gave some output."""
    some = F.coalesce(F.length(raw_output) > 0, F.lit(False))
    return some if return_code is None else some & (F.coalesce(return_code, F.lit(-1)) == 0)


def replay(outputs: DataFrame) -> Converter:
    """A converter that reads recorded outputs (case_id, raw_output, and return_code if they have one)."""
    code = F.col("return_code") if "return_code" in outputs.columns else None
    kept = outputs.select("case_id", "raw_output", *(["return_code"] if code is not None else []))
    return lambda cases: cases.join(kept, "case_id", "left").withColumn("ok", succeeded(F.col("raw_output"), code)).drop("return_code")


def native(spark: SparkSession, paths: Mapping[str, str], specs: Mapping[str, Spec], at_once: int = 8) -> Converter:
    """A converter that runs the engine's own plans: by case_id the input's path and its spec; ``at_once`` files side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        made = list(pool.map(lambda k: (k, by_spec(spark, paths[k], specs[k])), specs))
    return replay(spark.createDataFrame(made, "case_id string, raw_output string"))


CONVERTERS: dict[str, Callable[..., Converter]] = {"replay": replay, "native": native}


def converter(name: str, *given: Any, **options: Any) -> Converter:
    """The converter of that name, made with the rest of the arguments."""
    if name not in CONVERTERS:
        raise ValueError(f"unknown converter {name!r} (known: {', '.join(sorted(CONVERTERS))})")
    return CONVERTERS[name](*given, **options)


def output_sizes(text: Column) -> Column:
    """struct<bytes, est_tokens, preview> of a text: UTF-8 bytes, a quarter of its characters, its first 200 characters; a null text is empty."""
    said = F.coalesce(text, F.lit(""))
    return F.struct(F.octet_length(said).cast("long").alias("bytes"), F.floor(F.char_length(said) / 4).cast("long").alias("est_tokens"), F.substring(said, 1, 200).alias("preview"))


def evaluate(cases: DataFrame, convert: Converter, clean: bool = True) -> DataFrame:
    """Cases with output, cleanup steps, ok and scores; a failed conversion scores 0 throughout."""
    done = convert(cases)
    fmt = F.lower("output_format")
    c = cleaned(F.col("raw_output"), fmt) if clean else F.struct(F.col("raw_output").alias("text"), F.array().cast("array<string>").alias("applied"))
    done = done.withColumn("cleaned", c).withColumn("output", F.col("cleaned.text")).withColumn("scores", scores(F.col("cleaned.text"), F.col("expected_text"), fmt, F.col("required_substrings")))
    zero = F.struct(*[F.lit(0.0).alias(m) for m in METRICS])
    return done.withColumn("scores", F.when(F.col("ok"), F.col("scores")).otherwise(zero)).withColumn("output_preview", F.when(F.col("output").isNotNull(), output_sizes(F.col("output"))["preview"]))


def summarize(results: DataFrame) -> DataFrame:
    """(level, name, n, n_errors, four means): overall, by use case and by complexity in one GROUPING SETS aggregation."""
    flat = results.select("use_case", "complexity", "ok", *[F.col(f"scores.{m}").alias(m) for m in METRICS])
    means = [F.bround(F.avg(m), 3).alias(m) for m in METRICS]
    # (a) by use case, (b) by complexity, (c) overall
    grouped = flat.groupingSets([[F.col("use_case")], [F.col("complexity")], []], "use_case", "complexity").agg(
        F.grouping("use_case").alias("g_use_case"), F.grouping("complexity").alias("g_complexity"), F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_errors"), *means)
    level = F.when(F.col("g_use_case") == 0, "use_case").when(F.col("g_complexity") == 0, "complexity").otherwise("overall")
    name = F.when(F.col("g_use_case") == 0, F.col("use_case")).when(F.col("g_complexity") == 0, F.col("complexity")).otherwise("")
    return grouped.select(level.alias("level"), name.alias("name"), "n", "n_errors", *METRICS)


def latest_run(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    return runs.agg(F.max(run_id).alias(run_id))


#: Suffixes of output files by format.
SUFFIX = {"json": ".json", "csv": ".csv", "txt": ".txt"}


def artefacts(results: DataFrame) -> DataFrame:
    """(name, text): the files of each case, use_case/case/actual.*, raw_actual.* and teacher_meta.json, the last with sizes in bytes and the first 1000 characters of errors."""
    folder, fmt = F.concat_ws("/", "use_case_dir", "case"), F.lower("output_format")
    suffix = F.create_map(*[F.lit(x) for pair in SUFFIX.items() for x in pair])[fmt]
    error = F.substring(F.coalesce("error", F.lit("")), 1, 1000) if "error" in results.columns else F.lit("")
    output, raw = F.coalesce("output", F.lit("")), F.coalesce("raw_output", F.lit(""))
    facts = F.struct(F.col("ok"), output_sizes(F.col("input_text"))["bytes"].alias("input_bytes"), output_sizes(raw)["bytes"].alias("raw_size_bytes"), output_sizes(output)["bytes"].alias("cleaned_size_bytes"), F.col("cleaned.applied").alias("cleanup_applied"), error.alias("stderr"))
    files = F.array(
        F.struct(F.concat(folder, F.lit("/actual"), suffix).alias("name"), output.alias("text")), F.struct(F.concat(folder, F.lit("/raw_actual"), suffix).alias("name"), raw.alias("text")),
        F.struct(F.concat(folder, F.lit("/teacher_meta.json")).alias("name"), F.to_json(facts, {"pretty": "true"}).alias("text")))
    return results.select(F.inline(files))


def write_artefacts(results: DataFrame, path: str) -> int:
    """The artefacts as files below ``path``; how many were written."""
    return write_named_files(artefacts(results), path).count()


def summary(results: DataFrame, **facts: Any) -> dict:
    """The summary record of a run: ``facts`` (run_id, model, ...), the aggregate and its cases in order. A run's cases are few."""
    rows = summarize(results).collect()
    whole = next((r for r in rows if r.level == "overall"), None)
    by = lambda level: {r.name: {"n": r.n, **{m: r[m] for m in METRICS}} for r in sorted((r for r in rows if r.level == level), key=lambda r: r.name or "")}
    aggregate = {}
    if whole is not None and whole.n:
        aggregate = {"overall": {m: whole[m] for m in METRICS}, "by_use_case": by("use_case"), "by_complexity": by("complexity"), "n_cases": whole.n, "n_inference_errors": whole.n_errors}
    own = [c for c in ("case_id", "use_case", "complexity", "input_format", "output_format", "ok", "error", "elapsed_sec", "scores", "output_preview") if c in results.columns]
    return {**facts, "aggregate": aggregate, "cases": [r.asDict(recursive=True) for r in select_cases(results).select(*own).collect()]}


def write_summary(results: DataFrame, path: str, **facts: Any) -> None:
    """summary.json below ``path``, and both tables as Parquet beside it."""
    spark = results.sparkSession
    record = spark.createDataFrame([("summary.json", json.dumps(summary(results, **facts), indent=2, ensure_ascii=False))], "name string, text string")
    write_named_files(record, path).count()
    summarize(results).write.parquet(f"{path}/summary")
    results.write.parquet(f"{path}/cases")
