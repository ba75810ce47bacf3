"""Tool-call linking with DataFrame functions only.

Calls and results meet in a hash join on their identifier. Calls are ordered so that each comes after those it
needs; arguments are checked against a table of schemas; each call becomes one line of canonical JSON (keys sorted, no
spaces), which Spark's variant type gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Types a schema may ask for, and what Spark calls variants of them.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
LANE = 4096


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, problems): how many arguments are unknown, of a wrong type or missing; null: not JSON.

    schemas: name, argument, kind (a key of KINDS), required. A call whose name has no schema has one problem at least.
    """
    spark = calls.sparkSession
    key = ["conv_id", "call_id", "position"]
    parsed = calls.select(*key, "name", F.try_parse_json("arguments").alias("args"))
    given = parsed.where("args IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("args").outer())).select(*key, "name", F.col("key").alias("argument"), F.schema_of_variant("value").alias("is"))
    pattern = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rules = schemas.select(F.col("name").alias("rule_name"), F.col("argument").alias("rule_argument"), "required", F.concat(F.lit("^("), pattern[F.col("kind")], F.lit(")$")).alias("fits"))
    met = given.join(rules, (F.col("name") == F.col("rule_name")) & (F.col("argument") == F.col("rule_argument")), "left")
    bad = F.when(F.col("rule_name").isNull(), 1).when(F.regexp_like("is", F.col("fits")), 0).otherwise(1)
    need = schemas.groupBy("name").agg(F.count_if("required").alias("needed"))
    seen = met.groupBy(*key).agg(F.sum(bad).alias("bad"), F.sum(F.when(F.col("required"), 1).otherwise(0)).alias("found"))
    seen = seen.select(*[F.col(k).alias(f"seen_{k}") for k in key], "bad", "found")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"seen_{k}"))
    out = parsed.join(need, "name", "left").join(seen, same, "left")
    problems = F.coalesce("bad", F.lit(0)) + F.coalesce("needed", F.lit(1)) - F.coalesce("found", F.lit(0))
    return out.select(*key, F.when(F.col("args").isNotNull(), problems).alias("problems")).dropDuplicates(key)


def ordered(calls: DataFrame, rounds: int = 2) -> DataFrame:
    """(conv_id, call_id, late, hops, cyclic, missing): sort keys that put each call after those it needs.

    calls: conv_id, call_id, position, after (array of call ids of the same conversation). A call's key is the latest
    position among itself and what it needs, and the number of steps past the call at that position. Keys are
    relaxed, which a log in order does not need and one with calls near their places soon ends; conversations that
    still move after `rounds` are settled by contraction. A call that needs itself, and all that need it, are cyclic;
    their keys are unspecified. `missing` counts needs that no call meets.
    """
    key = ["conv_id", "call_id"]
    one = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min("position").alias("position"))
    size = one.groupBy("conv_id").agg(F.count("*").alias("calls"))
    needs = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(*key, F.explode(F.array_distinct("after")).alias("need")).where("need IS NOT NULL").distinct()
    met = needs.join(one.select("conv_id", F.col("call_id").alias("need"), F.lit(1).alias("met")), ["conv_id", "need"], "left")
    missing = met.groupBy(*key).agg(F.sum(F.when(F.col("met").isNull(), 1).otherwise(0)).alias("missing"))
    keys = one.join(size, "conv_id").join(missing, key, "left").select(*key, "calls", F.coalesce("missing", F.lit(0)).alias("missing"), F.col("position").alias("late"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("cyclic"))
    keys = written(keys, "call-keys")
    needs = written(needs, "call-needs")
    for left in range(rounds, -1, -1):
        of = keys.select("conv_id", F.col("call_id").alias("need"), F.struct("late", (F.col("hops") + 1).alias("hops")).alias("k"))
        least = needs.join(of, ["conv_id", "need"]).groupBy(*key).agg(F.max("k").alias("k"))
        late = written(least.join(keys, key).where(F.col("k") > F.struct("late", "hops")).select(*key, "k"), "call-late")
        if late.isEmpty():
            break
        if not left:
            keys = _contracted(keys, needs, late.select("conv_id").distinct())
            break
        keys = written(_raised(keys, late), "call-keys")
    return keys.drop("calls")


def _raised(keys: DataFrame, to: DataFrame) -> DataFrame:
    """keys, at least as late as `to` (conv_id, call_id, k) says."""
    k = F.greatest(F.struct("late", "hops"), "k")
    return keys.join(to, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "calls", "missing", k["late"].alias("late"), k["hops"].alias("hops"), "cyclic")


def _contracted(keys: DataFrame, needs: DataFrame, conversations: DataFrame) -> DataFrame:
    """keys with those of `conversations` settled; the others as they are.

    A need of a call without open needs is met; a need of a call with just one is led on to that one, so that chains halve
    in each round. A path of as many steps as the conversation has calls holds a cycle, and where nothing moves every
    open call needs a cycle. Each round meets, merges or lengthens needs, so there is no limit to set: chains and
    trees take about log2 of their depth, meshes of calls with several open needs each up to their depth.
    """
    key = ["conv_id", "call_id"]
    rest = keys.join(conversations, "conv_id", "left_anti")
    keys = written(keys.join(conversations, "conv_id", "left_semi"), "call-keys")
    edges = written(needs.join(keys.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select(*key, "need", F.lit(1).cast("long").alias("w")), "call-edges")
    while not edges.isEmpty():
        open_ = edges.groupBy(*key).agg(F.count("*").alias("n"), F.max("need").alias("next"), F.max("w").alias("more"))
        of = keys.join(open_, key, "left").select("conv_id", F.col("call_id").alias("need"), "calls", "late", "hops", "cyclic", F.coalesce("n", F.lit(0)).alias("n"), "next", "more")
        step = written(edges.join(of, ["conv_id", "need"]), "call-steps")
        moves = step.where("n <= 1 OR cyclic")
        stuck = moves.isEmpty()
        round_ = step if stuck else step.where("cyclic OR (n = 1 AND w + more >= calls)")
        round_ = written(round_.select(*key).distinct(), "call-cycles")
        later = moves.where("NOT cyclic").groupBy(*key).agg(F.max(F.struct("late", (F.col("hops") + F.col("w")).alias("hops"))).alias("k"))
        keys = _raised(keys, later).join(round_.withColumn("found", F.lit(True)), key, "left")
        keys = written(keys.withColumn("cyclic", F.col("cyclic") | F.coalesce("found", F.lit(False))).drop("found"), "call-keys")
        led = step.where("n > 0 AND NOT cyclic").select(*key, F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("need")).alias("need"), F.when(F.col("n") == 1, F.col("w") + F.col("more")).otherwise(F.col("w")).alias("w"))
        edges = written(led.join(round_, key, "left_anti").groupBy(*key, "need").agg(F.max("w").alias("w")), "call-edges")
    return rest.unionByName(keys)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, name, step, linked, valid, missing, cyclic, message.

    calls: conv_id, call_id, position, name, arguments (JSON), after; results: conv_id, call_id, position, content;
    other columns are ignored, whatever their names. step numbers a conversation's calls from 1 in topological order;
    cyclic calls have none.
    Of several results with one identifier the earliest counts. Arguments that are null or not JSON make a call
    invalid and stand as null in the message. Calls without conversation or identifier are left out, of calls that
    share both the earliest stays (of equal positions the least name and arguments). Results without a call are left out. Empty
    tables give an empty result.
    """
    calls = calls.select("conv_id", "call_id", "position", "name", "arguments", "after").where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "name", "arguments", "after")).alias("c"))
    calls = written(first.select("conv_id", "call_id", "c.*"), "calls")
    answer = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("r"))
    answer = answer.select("conv_id", "call_id", F.col("r.content").alias("content"), F.lit(True).alias("linked"))
    both = calls.join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    both = both.join(ordered(calls), ["conv_id", "call_id"])
    both = both.join(checked(calls, schemas).select("conv_id", "call_id", "problems"), ["conv_id", "call_id"])
    # numbered in lanes of positions, so that a long conversation is not one task's
    both = both.withColumn("lane", F.floor(F.col("late") / LANE))
    per = both.groupBy("conv_id", "lane").agg(F.count_if(~F.col("cyclic")).alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = both.join(per.select(F.col("conv_id").alias("c"), F.col("lane").alias("l"), "before"), (F.col("conv_id") == F.col("c")) & F.col("lane").eqNullSafe(F.col("l")))
    step = F.when(~F.col("cyclic"), F.row_number().over(Window.partitionBy("conv_id", "lane", "cyclic").orderBy("late", "hops", "call_id")) + F.col("before"))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("v")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("v"))))) - 6), F.lit("null"))
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null")), F.lit(',"id":'), quoted("call_id"),
        F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}"),
    )
    return both.select("conv_id", "call_id", "name", step.cast("long").alias("step"), F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce(F.col("problems") == 0, F.lit(False)).alias("valid"), "missing", "cyclic", canonical.alias("message"))


#: Schemas of the calls that conversation_calls makes.
TURN_SCHEMAS = [(n, a, k, True) for n in ("configure", "reply") for a, k in (("chars", "integer"), ("text", "string"), ("turn", "integer"))] + [("lookup", "word", "string", True), ("lookup", "limit", "integer", True), ("lookup", "near", "boolean", False)]


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made from plain conversations (conv_id, turn, role, text), which hold none; other roles are left out.

    A user's or system's turn calls for what comes next, and an assistant's turn is the result of the turn before. By the
    remainder of conv_id by 4, a user's turn needs the user's turn two before it (0 and 3), two after it (1: a log in
    reverse) or both (2: a cycle). A turn of over 20 words also makes a lookup, which it needs. A lookup has a result if
    its turn's words are an even number; its limit is a string where the turn divides by 3, and its arguments are no
    JSON where the remainder of conv_id by 7 is 3.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    words = F.size(F.split("text", " "))
    args = F.to_json(F.struct("turn", "text", F.length("text").alias("chars")), {"ignoreNullFields": "false"})
    user = F.col("role") == "user"
    at = lambda n: F.concat(F.lit("turn-"), n)
    needs = F.array_compact(F.array(F.when(user & (turn >= 2) & (conv % 4 != 1), at(turn - 2)), F.when(user & (conv % 4).isin(1, 2), at(turn + 2)), F.when(words > 20, F.concat(at(turn), F.lit("/lookup")))))
    asked = conversations.where("role IN ('user', 'system')")
    calls = asked.select("conv_id", at(turn).alias("call_id"), turn.alias("position"), F.when(user, "reply").otherwise("configure").alias("name"), args.alias("arguments"), needs.alias("after"))
    word = F.element_at(F.split("text", " "), 1).alias("word")
    given = F.when(conv % 7 == 3, "{broken").when(turn % 3 == 0, F.to_json(F.struct(word, words.cast("string").alias("limit")))).otherwise(F.to_json(F.struct(word, words.alias("limit"))))
    inner = asked.where(words > 20)
    lookups = inner.select("conv_id", F.concat(at(turn), F.lit("/lookup")).alias("call_id"), turn.alias("position"), F.lit("lookup").alias("name"), given.alias("arguments"), F.array().cast("array<string>").alias("after"))
    found = inner.where(words % 2 == 0).select("conv_id", F.concat(at(turn), F.lit("/lookup")).alias("call_id"), turn.alias("position"), word.alias("content"))
    told = conversations.where("role = 'assistant'").select("conv_id", at(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls.unionByName(lookups), told.unionByName(found)


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """link() over the calls that conversation_calls makes."""
    calls, results = conversation_calls(conversations)
    schemas = conversations.sparkSession.createDataFrame(TURN_SCHEMAS, "name string, argument string, kind string, required boolean")
    return link(calls, results, schemas)
