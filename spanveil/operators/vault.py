"""The vault: token, slug, value, value hash, rule, times; and what is done with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.spans import explode_rows, splice, value_at
from spanveil.functions.tokens import TOKEN, format_token, is_token, parse_tokens, slug, token_id, value_hash


def mint(values: DataFrame, salt: Column | None = None, vault: DataFrame | None = None) -> DataFrame:
    """values: value, rule_id, seen (what orders sightings). One token a distinct value, named by its first sighting.

    vault: tokens minted before; values that it holds get none, and its ids are taken. Only new rows are returned.
    One exchange on the value; first sightings are found by partial aggregation, so a value that is
    everywhere costs a row a task. Ids that collide are lengthened."""
    checked = values.withColumn("value", F.when(F.col("value") == "", F.raise_error(F.lit("an empty value can't have a token")).cast("string")).otherwise(F.col("value")))
    salted = salt if salt is not None else F.lit("")
    first = checked.groupBy("value").agg(F.min_by("rule_id", F.struct("seen", "rule_id")).alias("rule_id"), F.min("seen").alias("first_seen"), F.count("*").alias("sightings"))
    if vault is not None:
        first = first.join(vault.select("value"), "value", "left_anti")
    ids = first.withColumn("_id", token_id(F.col("value"), salted)).withColumn("_clash", F.count("*").over(Window.partitionBy("_id")) > 1)
    if vault is not None:
        taken = vault.select(F.regexp_extract("token", TOKEN, 2).alias("_id"), F.lit(True).alias("_taken")).distinct()
        ids = ids.join(taken, "_id", "left").withColumn("_clash", F.col("_clash") | F.coalesce("_taken", F.lit(False)))
    ids = ids.withColumn("_id", F.when(F.col("_clash"), token_id(F.col("value"), salted, 64)).otherwise(F.col("_id")))
    return ids.select(format_token(slug(F.col("rule_id")), F.col("_id")).alias("token"), "value", value_hash(F.col("value")).alias("value_hash"), "rule_id", "first_seen", "sightings")


def tokenise(detected: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and output: each span of detected replaced by the token that vault has for its value, whichever rule found it here.

    Only spans shuffle on their values; a text shuffles on its id, and only if it has a span. A value that vault lacks is an error."""
    rows = detected.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"), "spans")
    plain = rows.filter(F.size("spans") == 0).select(id_col, F.col("_t").alias("output"))
    rows = rows.filter(F.size("spans") > 0)
    found = explode_rows(rows, "spans", "s", id_col, "_t").select(id_col, F.col("s.start").alias("start"), F.col("s.end").alias("end"), value_at(F.col("_t"), F.col("s")).alias("value"))
    named = found.join(vault.select("value", "token"), "value", "left")
    token = F.coalesce("token", F.raise_error(F.lit("a value without a token")).cast("string"))
    tokens = named.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", token.alias("v")))).alias("_s"))
    done = rows.select(id_col, "_t").join(tokens, id_col)
    return done.select(id_col, splice(F.col("_t"), F.col("_s"), lambda s, _: s["v"]).alias("output")).unionByName(plain)


def resolve(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """tokens: raw. Adds value, null where the vault lacks it."""
    return tokens.join(vault.select(F.col("token").alias("raw"), "value"), "raw", "left")


def restore(texts: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, output (known tokens replaced, once, not recursively), missing (sorted), n_tokens, decision.

    A text with any unknown token is denied; one without tokens is allowed as it is."""
    # Filters look at the text itself: a filter on the parsed tokens would be pushed below, with its expression copied.
    given = texts.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    plain = given.filter(~is_token(F.col("_t"))).select(id_col, F.col("_t").alias("output"), F.array().cast("array<string>").alias("missing"), F.lit(0).cast("long").alias("n_tokens"))
    rows = explode_rows(given.filter(is_token(F.col("_t"))), parse_tokens(F.col("_t")), "k", id_col, "_t").select(id_col, "_t", F.col("k.raw").alias("raw"), F.col("k.start").alias("start"), F.col("k.end").alias("end"))
    found = resolve(rows, vault)
    spans = F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("value", "raw").alias("v"))))
    lost = F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("raw"))))
    done = found.groupBy(id_col, "_t").agg(spans.alias("_s"), lost.alias("missing"), F.count("*").alias("n_tokens"))
    done = done.select(id_col, splice(F.col("_t"), F.col("_s"), lambda s, _: s["v"]).alias("output"), "missing", "n_tokens")
    return done.unionByName(plain).withColumn("decision", F.when(F.size("missing") > 0, "deny").otherwise("allow"))


def rotate(vault: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: token, new_value. The token keeps its name; the old value's hash is given up. Unknown tokens and empty values are errors."""
    joined = vault.join(updates, "token", "full_outer")
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.col("token"))).cast("string")
    new = F.when(F.col("value").isNull(), fail("unknown token: ")).when(F.col("new_value") == "", fail("empty value for ")).otherwise(F.coalesce("new_value", "value"))
    return joined.withColumn("value", new).withColumn("value_hash", value_hash(F.col("value"))).select(*vault.columns)


def rotation_audit(vault: DataFrame, updates: DataFrame, tool: str = "rotate") -> DataFrame:
    """An audit row for each token that updates changes: hashes of the new and the old value, cut to 12 digits, and no value."""
    short = lambda c: F.substring(value_hash(F.col(c)), 1, 12)
    return vault.join(updates, "token").select(
        F.lit("vault-rotate").alias("ruleId"), F.lit(tool).alias("tool"), F.lit("rewrite").alias("action"), F.col("token").alias("tokenRef"), short("new_value").alias("valueHash"), F.create_map(F.lit("previousValueHash"), short("value")).alias("context")
    )


def eviction_audit(marked: DataFrame, tool: str = "read") -> DataFrame:
    """marked: see evict. An audit row for each token that was dropped."""
    return marked.filter("evicted").select(F.lit("vault-evict").alias("ruleId"), F.lit(tool).alias("tool"), F.lit("evict").alias("action"), F.col("token").alias("tokenRef"), F.create_map(F.lit("reason"), F.lit("lru-cap")).alias("context"))


def owners(vault: DataFrame) -> DataFrame:
    """value_hash, token: where two tokens hold a value, the older one answers for it."""
    return vault.groupBy("value_hash").agg(F.min_by("token", F.struct("first_seen", "token")).alias("token"))


def evict(vault: DataFrame, cap: int, used: str = "last_used") -> DataFrame:
    """vault with evicted: all but the cap most recently used; 0 is no cap.

    The cap-th most recent use is found first (a top-k), so that no single task ranks the vault."""
    if cap == 0:
        return vault.withColumn("evicted", F.lit(False))
    edge = vault.select(F.struct(used, "token").alias("_e")).orderBy(F.desc("_e")).limit(cap).agg(F.min("_e").alias("_edge"), F.count("*").alias("_n"))
    return vault.crossJoin(F.broadcast(edge)).withColumn("evicted", (F.col("_n") == cap) & (F.struct(used, "token") < F.col("_edge"))).drop("_edge", "_n")


def stats(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("entries"), F.min("first_seen").alias("created"))


def seal(vault: DataFrame, key: Column) -> DataFrame:
    """The value column encrypted with AES-GCM; key: 32 bytes, as a column so that it stays out of the plan."""
    return vault.withColumn("value", F.aes_encrypt(F.col("value"), key, F.lit("GCM")))


def unseal(vault: DataFrame, key: Column) -> DataFrame:
    """Fails on a wrong key or a changed value."""
    return vault.withColumn("value", F.aes_decrypt(F.col("value"), key, F.lit("GCM")).cast("string"))


def save(vault: DataFrame, path: str, key: Column) -> None:
    seal(vault, key).write.mode("overwrite").parquet(path)


def wipe(vault: DataFrame, path: str) -> None:
    vault.limit(0).write.mode("overwrite").parquet(path)


#: A string of JSON text; a colon after it makes it a key.
JSON_STRING = r'"(?:[^"\\]|\\.)*":?'


def restore_json(requests: DataFrame, vault: DataFrame, id_col: str = "doc_id", col: str = "payload") -> DataFrame:
    """id, output, missing (the first three, sorted), n_tokens, decision: known tokens in the string leaves of JSON, at any depth, replaced by their values.

    Keys stay. A request with any unknown token is denied as it is, and one that is no JSON, or null, too. Values are
    escaped as JSON asks, and replaced once: a value that looks like a token stays."""
    given = requests.select(id_col, F.col(col).alias("_raw"), F.to_json(F.try_parse_json(col)).alias("_j"))
    strings = F.regexp_extract_all("_j", F.lit(JSON_STRING), F.lit(0))
    cut = given.filter("_j is not null").select(id_col, "_raw", "_j", strings.alias("_strings"), F.split("_j", JSON_STRING, -1).alias("_between"))
    leaves = F.array_join(F.filter("_strings", lambda s: ~s.endswith(":")), " ")
    seen = cut.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(leaves, F.lit(TOKEN), F.lit(0)))).alias("raw"))
    inner = F.to_json(F.struct(F.col("value").alias("v")))
    known = resolve(seen, vault).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("raw", F.substring(inner, F.lit(7), F.length(inner) - 8))))).alias("_known"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("raw")))), 1, 3).alias("missing"), F.count("*").alias("n_tokens"),
    )
    rows = cut.join(known, id_col, "left")
    filled = F.transform("_strings", lambda s: F.when(s.endswith(":"), s).otherwise(splice(s, parse_tokens(s), lambda _, v: F.element_at("_known", v))))
    whole = F.concat(F.array_join(F.zip_with(F.slice("_between", F.lit(1), F.size("_strings")), filled, lambda a, b: F.concat(a, b)), ""), F.element_at("_between", -1))
    none = F.array().cast("array<string>")
    ok = rows.select(id_col, F.when(F.col("n_tokens").isNull() | (F.size("missing") > 0), F.col("_raw")).otherwise(whole).alias("output"), F.coalesce("missing", none).alias("missing"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    ok = ok.withColumn("decision", F.when(F.size("missing") > 0, "deny").otherwise("allow"))
    bad = given.filter("_j is null").select(id_col, F.col("_raw").alias("output"), none.alias("missing"), F.lit(0).cast("long").alias("n_tokens"), F.lit("deny").alias("decision"))
    return ok.unionByName(bad)
