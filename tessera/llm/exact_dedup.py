"""Exact duplicates through content-defined chunk recipes, in DataFrame operations only.

Each text is cut where its own content says so, each chunk becomes a 64-bit
identifier, and a document becomes the ordered list of them (its recipe).
Documents are compared by recipe, so a text is read once, where it lies, and only
recipes are moved.  Identifiers are then verified by the SHA-256 digests of their
chunks: in documents that share a recipe, an identifier that stands for more than
one digest is ambiguous, and documents that hold such a one are compared by their
digests as well, so a collision of identifiers never joins two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored

#: Parts of a group of copies that are joined with its result apart.
SALTS = 8
#: A chunk ends after white space followed by one of these, once it has the least length.
BOUNDARY = r"[\s][jkqvxyzJKQVXYZ0-9#éñß]"


def chunks_of(text: Column, least: int = 256, most: int = 4096, boundary: str = BOUNDARY) -> Column:
    """The text's chunks in order; together they are the text.  The cut depends only on the text around it."""
    pattern = rf"(?s).{{{least},{most}}}?(?:(?<={boundary})|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_duplicates(documents: DataFrame, *, least: int = 256, most: int = 4096, identifier=F.xxhash64) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical after lower-casing A-Z.  Exactly
    one row of a group is kept: that with the largest doc_id, any one of those
    that repeat it, and any row of a group whose ids are all null, which then has
    a null keep_id.  Null text counts as empty, empty texts equal one another,
    repeated rows each count, other columns are ignored, and an empty table gives
    no rows.  Empty texts, which may be many, need no recipe and are dealt nowhere.
    identifier maps a chunk to a BIGINT; any function of the chunk gives right results.
    """
    base = documents.select("doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    cut = base.select("doc_id", "t", chunks_of(F.col("t"), least, most).alias("c"))
    recipes = stored(
        cut.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.transform("c", lambda c: identifier(c).cast("long")).alias("recipe"),
            F.transform("c", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
            F.length("t").cast("long").alias("n_chars"),
            F.sha2("t", 256).alias("text_sha256"),
        ),
        "recipes",
    )
    key = ["recipe", "n_chars"]
    repeated = recipes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1 and n_chars > 0").drop("n")
    # one line for each list of digests: copies have the same
    suspects = recipes.select(*key, "digests").distinct().join(repeated, key, "left_semi")
    pieces = suspects.select(F.explode(F.arrays_zip("recipe", "digests")).alias("p")).select(F.col("p.recipe").alias("h"), F.col("p.digests").alias("d"))
    ambiguous = stored(pieces.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select("h"), "ambiguous")
    own = ["doc_id", "row", "text_sha256", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")]
    full = recipes.where("n_chars > 0")
    compared = full.select(*key, *own)
    if not ambiguous.isEmpty():
        held = recipes.select("recipe", F.explode("recipe").alias("h")).join(ambiguous, "h", "left_semi").select("recipe").distinct().withColumn("doubtful", F.lit(True))
        told = full.join(held, "recipe", "left").withColumn("variant", F.when(F.col("doubtful"), F.col("digests")).otherwise(F.expr("cast(array() as array<binary>)")))
        key = [*key, "variant"]
        compared = told.select(*key, *own)
    kept = F.max_by("row", F.coalesce("doc_id", F.lit(-(2**63)))).alias("keep_row")
    sums = [F.max("doc_id").alias("keep_id"), kept, F.count("*").alias("group_size")]
    groups = compared.groupBy(*key).agg(*sums).where("group_size > 1")
    # each group of copies is there SALTS times, so a large one is dealt to several tasks; others need no partner
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = compared.join(groups.withColumn("salt", F.col("salt").cast("long")), [*key, "salt"], "left")
    empty = recipes.where("n_chars = 0")
    found = found.select(*own[:3], "keep_id", "keep_row", "group_size").unionByName(empty.crossJoin(F.broadcast(empty.agg(*sums))).select(*own[:3], "keep_id", "keep_row", "group_size"))  # one row
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
