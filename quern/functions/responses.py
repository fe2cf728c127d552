"""Reading segments out of model answers: JSON in its many disguises, then lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.chunks import covers, let, semantic_chunks, source_windows, split_text
from quern.plans.tables import written

# Keys and patterns of the answers that are understood.
LIST_KEYS = ["chunks", "segments", "items", "data"]
TEXT_KEYS = ["text", "content", "chunk", "value"]
FENCED = r"(?is)```(?:json)?\s*(.*?)```"
LIST_ITEM = r"^\s*(?:\d+[.)]|[-*])\s+(.*\S)\s*$"
PLACEHOLDER = r"(?i)^(chunk|segment)\s*(text)?\s*\d*$|^placeholder$|^example$"


def candidates(raw: Column) -> Column:
    """Texts that may be JSON: the whole, fenced blocks, the widest [...] and {...}."""
    fenced = F.transform(F.regexp_extract_all(raw, F.lit(FENCED), F.lit(1)), F.trim)
    every = F.concat(F.array(F.trim(raw)), fenced, F.array(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1)))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def _texts(v: Column) -> Column:
    """The non-blank texts of a variant array's elements: strings, or objects' first non-blank text key."""
    keys = lambda e: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(e, f"$.{k}", "string")), F.lit("")) for k in TEXT_KEYS])
    plain = lambda e: F.when(F.schema_of_variant(e).startswith("OBJECT"), keys(e)).when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
    return F.filter(F.transform(v, lambda e: F.trim(plain(e))), lambda s: s.isNotNull() & (s != ""))


def _payload(candidate: Column) -> Column:
    """The texts of a candidate: a list, or the first key of LIST_KEYS that holds some."""
    v = F.try_parse_json(candidate)
    empty = F.array().cast("array<string>")
    found = F.transform(F.array(*[F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")) for path in ["$", *[f"$.{k}" for k in LIST_KEYS]]]), _texts)
    return F.coalesce(F.try_element_at(F.filter(found, lambda t: F.size(t) > 0), F.lit(1)), empty)


def segments(raw: Column) -> Column:
    """The segments of an answer: of the first candidate that parses to some, else of a numbered or bulleted list."""
    parsed = F.filter(F.transform(candidates(raw), _payload), lambda x: F.size(x) > 0)
    listed = F.transform(F.filter(T.lines(raw), lambda s: T.rx(s, LIST_ITEM)), lambda s: F.regexp_extract(s, LIST_ITEM, 1))
    return F.when(F.size(parsed) > 0, F.element_at(parsed, 1)).otherwise(listed)


def is_placeholder(chunks: Column) -> Column:
    """Whether nothing in a list of chunks is content."""
    return F.forall(chunks, lambda c: (F.length(F.trim(c)) < 5) | T.rx(F.trim(c), PLACEHOLDER) | F.contains(F.lower(c), F.lit("chunk text")))


def bounded_chunks(chunks: Column, size: int, overlap: int) -> Column:
    return F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) <= size, F.array(c)).otherwise(split_text(c, size, overlap))))


def message(raw: Column, joiner: str = "\n") -> Column:
    """The content of a chat answer's first choice: a string, or its text parts joined."""
    v = F.try_parse_json(raw)
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    kind = F.schema_of_variant(content)
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))), lambda s: s.isNotNull() & (s != ""))
    return F.trim(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, joiner)).otherwise(F.lit("")))


# -- segmentation by a model, with the rule-based split to fall back on ---------------------------------------

WINDOW = 8000
SLACK = 1.2  # texts a little over the limit are not worth a call


def segment_prompt(text: Column, title: Column, size: int) -> Column:
    return F.concat(F.lit(f"Split the text into passages of at most {size} characters at changes of topic. Quote it exactly; leave nothing out. Answer with a JSON object with a list under \"chunks\".\nTitle: "), title, F.lit("\nText:\n"), text)


def repair_prompt(text: Column, answer: Column, size: int) -> Column:
    return F.concat(F.lit(f"The answer below is not a list of exact quotations of at most {size} characters that cover the text. Mend it; answer with a JSON list only.\nAnswer:\n"), answer, F.lit("\nText:\n"), text)


def accepted(text: Column, raw: Column, size: int, overlap: int) -> Column:
    """An answer's chunks if they quote and cover the text, bounded; else null."""
    found = segments(F.coalesce(raw, F.lit("")))
    return let(found, lambda c: F.when((F.size(c) > 0) & ~is_placeholder(c) & covers(text, c, overlap), bounded_chunks(c, size, overlap)))


ANALYZER_ROUNDS = 400


def _allow_deep_plans() -> None:
    """Folds within folds over windows need more rounds of the analyzer than a session has by default: one for each level."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.analyzer.maxIterations"
    if spark is not None and int(spark.conf.get(key)) < ANALYZER_ROUNDS:
        spark.conf.set(key, str(ANALYZER_ROUNDS))


def model_chunks(text: Column, title: Column, ask: list, size: int = 1200, overlap: int = 180) -> Column:
    """Chunks of a text by a model.

    ``ask`` is a list of functions (prompt column -> answer column), tried in
    turn; the last is given its predecessor's answer to mend.  Short texts are
    one chunk, texts a little longer are split by rules, and so is every window
    whose answers are all refused.  Windows are asked one by one.
    """

    def window(w: Column) -> Column:
        tries, before = [], None
        for i, f in enumerate(ask):
            prompt = segment_prompt(w, title, size) if before is None or i < len(ask) - 1 else repair_prompt(w, F.coalesce(before, F.lit("")), size)
            before = f(prompt)
            tries.append(accepted(w, before, size, overlap))
        return F.coalesce(*tries, semantic_chunks(w, size, overlap))

    _allow_deep_plans()
    clean = T.collapse(text)
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).when(F.length(clean) <= size, F.array(clean)).when(F.length(clean) < SLACK * size, semantic_chunks(text, size, overlap)).otherwise(F.flatten(F.transform(source_windows(text, WINDOW), window)))


def chunk_rows(rows: DataFrame, ask: list, size: int = 1200, overlap: int = 180) -> DataFrame:
    """(node_id, chunks) of rows (node_id, title, text): ``model_chunks`` for functions that call out from Python, which no expression over array elements can.

    Each window is a row; only windows whose answers were refused are asked
    again, and answers are written before they are looked at, so that none is
    asked for twice.
    """
    given = rows.select("node_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.length(T.collapse(F.coalesce("text", F.lit("")))).alias("n"))
    asking = F.col("n") >= SLACK * size
    plain = F.when(F.col("n") == 0, F.array().cast("array<string>")).when(F.col("n") <= size, F.array(T.collapse(F.col("text")))).otherwise(semantic_chunks(F.col("text"), size, overlap))
    done = given.where(~asking).select("node_id", F.lit(0).alias("k"), plain.alias("chunks"))
    open_ = written(given.where(asking).select("node_id", "title", F.posexplode(source_windows(F.col("text"), WINDOW)).alias("k", "window"), F.lit(None).cast("string").alias("raw")), "windows")
    for i, f in enumerate(ask):
        first = i == 0 or i < len(ask) - 1
        prompt = segment_prompt(F.col("window"), F.col("title"), size) if first else repair_prompt(F.col("window"), F.coalesce("raw", F.lit("")), size)
        answered = written(open_.withColumn("raw", f(prompt)), "answers")
        taken = written(answered.withColumn("chunks", accepted(F.col("window"), F.coalesce(F.nullif(message(F.col("raw")), F.lit("")), F.col("raw")), size, overlap)), "taken")
        done = done.unionByName(taken.where("chunks is not null").select("node_id", "k", "chunks"))
        open_ = taken.where("chunks is null").drop("chunks")
    done = done.unionByName(open_.select("node_id", "k", semantic_chunks(F.col("window"), size, overlap).alias("chunks")))
    return done.groupBy("node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunks"))), lambda x: x.chunks)).alias("chunks"))
