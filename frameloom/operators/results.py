"""Results of runs: task rows, rates, retries, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.schema import TERMINAL_TOOLS, quote


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def total_tokens(prompt: Column, generated: Column, total: Column) -> Column:
    """total, or the sum of the parts where it is 0 or null."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, prompt + generated).otherwise(total)


def efficiency(tasks: DataFrame) -> DataFrame:
    """One row of a task table's counts and means. tokens_per_success and sec_per_success are over successes only, success_rate over scored tasks only; null where there are none.

    tasks(success, total_tokens, generated_tokens, total_sec, inference_sec); a success of null is not scored.
    """
    won = F.col("success") == True  # noqa: E712
    return tasks.agg(
        F.count("*").alias("n"), F.avg("total_tokens").alias("avg_total_tokens"), F.avg("generated_tokens").alias("avg_generated_tokens"), F.avg("total_sec").alias("avg_wall_sec"),
        F.avg("inference_sec").alias("avg_inference_sec"), F.avg(F.when(won, F.col("total_tokens"))).alias("tokens_per_success"), F.avg(F.when(won, F.col("total_sec"))).alias("sec_per_success"),
        F.count_if(won).alias("n_success"), _rate(F.col("success")).alias("success_rate"),
    )


def format_rates(tasks: DataFrame) -> DataFrame:
    """(domain, n, parsed, valid, parse_rate, valid_rate): a row for each domain and one, of domain null and whole true, for all. tasks(domain, parsed_ok, valid)."""
    by = tasks.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("parsed_ok")).alias("parsed"), F.count_if(F.col("valid")).alias("valid"))
    # the whole comes from the domains' counts: a row even where there are none
    whole = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "parsed", "valid"))).select(F.lit(None).cast(tasks.schema["domain"].dataType).alias("domain"), F.lit(True).alias("whole"), "n", "parsed", "valid")
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return by.select("domain", F.lit(False).alias("whole"), "n", "parsed", "valid").union(whole).withColumn("parse_rate", rate("parsed")).withColumn("valid_rate", rate("valid"))


def summary_lines(rates: DataFrame) -> list[str]:
    """The rates of format_rates as lines of text: the whole, then the domains by name."""
    found = rates.collect()
    whole = next(r for r in found if r["whole"])
    if not whole["n"]:
        return ["no examples evaluated."]
    share = lambda r, k: f"{r[k] / r['n']:.1%}"
    lines = [f"examples evaluated: {whole['n']}", f"parse rate: {share(whole, 'parsed')}", f"structural valid: {share(whole, 'valid')}"]
    return lines + [f"{r['domain']}: n={r['n']} parsed={share(r, 'parsed')} valid={share(r, 'valid')}" for r in sorted((r for r in found if not r["whole"]), key=lambda r: str(r["domain"]))]


def failure_modes(tasks: DataFrame, order: str = "task_id", limit: int = 10) -> DataFrame:
    """(mode, n) of the most frequent failures, ties by first appearance. tasks(parse_error string, errors array<string>): a mode is the text before the first colon."""
    head = lambda e: F.substring(F.split(e, ":", 2)[0], 1, 50)
    modes = F.concat(
        F.when(F.coalesce("parse_error", F.lit("")) != "", F.array(F.concat(F.lit("parse: "), head(F.col("parse_error"))))).otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e: F.concat(F.lit("validation: "), head(e))),
    )
    found = tasks.select(F.col(order).alias("_order"), F.posexplode(modes).alias("_i", "mode"))
    counts = found.groupBy("mode").agg(F.count("*").alias("n"), F.min(F.struct("_order", "_i")).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(limit).select("mode", "n")


def weighted_accuracy(categories: DataFrame) -> DataFrame:
    """One row of the accuracies' mean, weighted by their counts where there are any. categories(accuracy, n)."""
    weights = F.sum(F.when(F.col("accuracy").isNotNull(), F.col("n")))
    return categories.agg(F.coalesce(F.sum(F.col("accuracy") * F.col("n")) / F.nullif(weights, F.lit(0)), F.avg("accuracy")).alias("primary"))


def is_multi_turn(entry_id: Column) -> Column:
    return entry_id.startswith("multi_turn")


def retries(entry_id: Column, turns: Column) -> Column:
    """Steps beyond the first of each turn; 0 for entries of a single turn. turns: array<array<string>>, null if the result is plain text."""
    steps = F.aggregate(turns, F.lit(0), lambda acc, t: acc + F.greatest(F.lit(0), F.coalesce(F.size(t), F.lit(0)) - 1))
    return F.when(is_multi_turn(entry_id) & turns.isNotNull(), steps).otherwise(0)


def retry_metrics(rows: DataFrame) -> DataFrame:
    count = retries(F.col("id"), F.col("turns"))
    return rows.agg(F.coalesce(F.avg(count), F.lit(0.0)).alias("avg_retry_count"), F.coalesce(F.sum(count), F.lit(0)).cast("double").alias("total_retry_count"))


def entry_validity(requested: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, valid): a requested id fails only if a score row says so; without a row it passes. scores(id, valid)."""
    failed = scores.where(~F.col("valid")).select("id").distinct().withColumn("_failed", F.lit(True))
    return requested.select("id").distinct().join(failed, "id", "left").select("id", F.col("_failed").isNull().alias("valid"))


def resolved(requested: DataFrame, report: DataFrame) -> DataFrame:
    """(id, resolved, primary) from a one-row report(submitted_instances, resolved_instances, resolved_ids); primary is null if none was submitted."""
    one = report.select(F.explode_outer("resolved_ids").alias("id")).where("id is not null").distinct().withColumn("_ok", F.lit(True))
    rate = report.agg(F.first(F.col("resolved_instances") / F.nullif(F.col("submitted_instances"), F.lit(0))).alias("primary"))
    return requested.select("id").join(one, "id", "left").crossJoin(F.broadcast(rate)).select("id", F.coalesce("_ok", F.lit(False)).alias("resolved"), "primary")


def resolved_of(requested: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, resolved) where the report's ids are a table, verdicts(id, ...): of any number, without being gathered into one row."""
    known = verdicts.where("id is not null").select("id").distinct().withColumn("_ok", F.lit(True))
    return requested.select("id").join(known, "id", "left").select("id", F.coalesce("_ok", F.lit(False)).alias("resolved"))


def places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with the place of each in the whole order, from 1, by range partitions: no task has all rows.

    The ordered rows are written to the checkpoint folder, as their partitions' bounds come from a sample that another run would
    draw anew; then the partitions' counts, as many as there are partitions, say where each begins. Ties stand in any order.
    """
    at = "_at"
    ordered = rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    joined = ordered.withColumn("_part", part).join(begins, "_part")
    return joined.select(*rows.columns, (F.col("_begin") + within + 1).alias(name))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: combined before the shuffle, so that a key may have any number of rows."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("_row"))
    return best.select(*(F.col(f"_row.{c}").alias(c) if c != key else F.col(key) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with new's rows in place of those of the same key; within either, the last by order."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1))).withColumn("_order", F.struct("_age", order))
    return latest(both, key, "_order").drop("_age", "_order")


def natural_order(entry_id: Column) -> list[Column]:
    """Sort by the id's text, then by its number at the end."""
    return [F.regexp_replace(entry_id, "[0-9]+$", "").asc(), F.regexp_extract(entry_id, "([0-9]+)$", 1).try_cast("long").asc_nulls_first()]


def category(entry_id: Column) -> Column:
    """The id without its last _part."""
    return F.regexp_replace(entry_id, "_[^_]*$", "")


def structural_pass(called: Column, available: Column, final_answer: Column, finished: Column) -> Column:
    """struct<ok, reason> of a tool run: it must finish, with an answer, and have called only tools that it was offered."""
    answer = F.coalesce(final_answer, F.lit(""))
    strange = F.size(F.array_except(called, available)) > 0
    reason = F.when(~finished, "no finish").when((answer == "") | answer.contains("give_up_and_restart"), "empty final answer").when(strange, "hallucination").otherwise("structural pass")
    return F.struct((reason == "structural pass").alias("ok"), reason.alias("reason"))


def tool_scores(rows: DataFrame) -> DataFrame:
    """One row of rates. rows(structural boolean, cache boolean, gpt boolean, steps): a null gpt was not judged, a null structural was not converted and fails."""
    none = F.count("*") == 0
    ok = F.coalesce("structural", F.lit(False))
    return rows.agg(
        F.count("*").alias("n"), F.when(none, 0.0).otherwise(_rate(ok)).alias("structural_pass_rate"), F.when(none, 0.0).otherwise(_rate(F.coalesce("cache", F.lit(False)))).alias("cache_pass_rate"),
        _rate(F.col("gpt")).alias("gpt_pass_rate"), F.coalesce(F.avg("steps"), F.lit(0.0)).alias("avg_steps"), F.count_if(ok).alias("structural_pass"),
    )


def accumulate(steps: DataFrame, by: str = "run_id") -> DataFrame:
    """A run's sums over its steps(prompt_tokens, generated_tokens, inference_sec, tool_sec)."""
    names = ["prompt_tokens", "generated_tokens", "inference_sec", "tool_sec"]
    return steps.groupBy(by).agg(F.count("*").alias("steps"), *(F.sum(c).alias(c) for c in names))


def share_load_time(tasks: DataFrame, load_sec: float) -> DataFrame:
    """tasks whose load_sec is not above 0 get an equal share of the run's."""
    # one row, made by the same job
    share = tasks.agg((F.lit(float(load_sec)) / F.greatest(F.count("*"), F.lit(1))).alias("_share"))
    shared = tasks.crossJoin(F.broadcast(share))
    return shared.withColumn("load_sec", F.when(F.col("load_sec") <= 0, F.col("_share")).otherwise(F.col("load_sec"))).select(*tasks.columns)


def patch_success(submitted: Column, patch: Column) -> Column:
    return submitted & (F.coalesce(patch, F.lit("")) != "")


def predictions(rows: DataFrame, model: str) -> DataFrame:
    """(instance_id, model_name_or_path, model_patch): the last patch of each instance, empty for none. rows(instance_id, model_patch, pos)."""
    return latest(rows, "instance_id", "pos").select("instance_id", F.lit(model).alias("model_name_or_path"), F.coalesce("model_patch", F.lit("")).alias("model_patch"))


def check_frames(violation_texts: Column, parse_error: Column, crashed: Column) -> Column:
    """struct<parsed_ok, valid, parse_error, errors> of a generation in frames."""
    errors = F.when(crashed, F.array(F.lit("validator crashed: action without keys"))).otherwise(violation_texts)
    none = F.array().cast("array<string>")
    parsed = parse_error.isNull()
    return F.struct(
        parsed.alias("parsed_ok"), (parsed & (F.size(errors) == 0)).alias("valid"), F.when(~parsed, F.concat(F.lit("parse failure: "), parse_error)).alias("parse_error"), F.when(parsed, errors).otherwise(none).alias("errors")
    )


def check_chat(raw: Column, call: Column, stop: Column) -> Column:
    """struct<parsed_ok, valid, parse_error, errors> of a chat model's generation: it must stop, and hold a call with a name, or text."""
    stops = raw.rlike(r"<\|(?:eot_id|eom_id)\|>")
    wrong = F.when(~stops, F.array(F.lit("no stop token emitted"))).when(stop.startswith("parse_error"), F.array(stop))
    nameless = F.when(call.isNotNull() & ~F.array_contains(F.json_object_keys(call), "name"), F.array(F.lit("tool call missing 'name' field")))
    errors = F.coalesce(wrong, nameless, F.array().cast("array<string>"))
    return F.struct(stops.alias("parsed_ok"), (F.size(errors) == 0).alias("valid"), F.when(~stops, "missing stop token").alias("parse_error"), errors.alias("errors"))


def encode_actions(actions: Column) -> Column:
    """JSON of the calls among action frames: terminal and nameless ones dropped; none: [], one: an object, more: a list."""
    calls = F.filter(actions, lambda a: (F.coalesce(a["tool"], F.lit("")) != "") & ~F.coalesce(a["tool"].isin(TERMINAL_TOOLS), F.lit(False)))
    texts = F.transform(calls, lambda a: F.concat(F.lit('{"name": '), quote(a["tool"]), F.lit(', "parameters": '), a["args"], F.lit("}")))
    return F.when(F.size(texts) == 0, "[]").when(F.size(texts) == 1, texts[0]).otherwise(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")))


def execution_results(calls: Column, outputs: Column) -> Column:
    """array<struct<tool, value>>: calls and outputs side by side, as far as both go; an empty output's value is null."""
    from frameloom.functions import text

    n = F.least(F.size(calls), F.size(outputs))
    pairs = F.arrays_zip(F.slice(calls, F.lit(1), n).alias("call"), F.slice(outputs, F.lit(1), n).alias("output"))
    return F.transform(pairs, lambda p: F.struct(text.called_tool(p["call"]).alias("tool"), F.nullif(text.strip(p["output"]), F.lit("")).alias("value")))


def repeats(rows: DataFrame, by: str, order: str, command: str, limit: int = 3) -> DataFrame:
    """rows with streak and repeated: how often a command has come in a row, and whether that reaches limit.

    An empty command has streak 0, is never repeated, and does not end a streak.
    """
    w = Window.partitionBy(by).orderBy(order)
    there = F.coalesce(command, F.lit("")) != ""
    said = rows.withColumn("_there", there).withColumn("_before", F.last(F.when(there, F.col(command)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("_there") & ~F.col(command).eqNullSafe(F.col("_before"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = said.withColumn("_island", F.sum(new.cast("int")).over(upto))
    streak = F.sum(F.col("_there").cast("int")).over(Window.partitionBy(by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = islands.withColumn("streak", F.when(F.col("_there"), streak).otherwise(0)).withColumn("repeated", F.col("streak") >= limit)
    return out.drop("_there", "_before", "_island")
