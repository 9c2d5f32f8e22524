"""A training corpus from raw documents: toxicity, language, near duplicates, mixture, tokens.

Every stage works on all documents that the one before kept. All but the last return the columns
of ``documents``; the last adds the tokens. ``run`` writes each stage's result as Parquet to the
session's shared folder and reads it again, so a lost executor costs one stage's tasks at most.

SQL cannot express the first two stages and the last one, so there is no oracle; the tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import byte_bpe, language_id, minhash, mixing, toxicity
from strandframe.llm.common import col, cols, drop, stash, table, unused

#: A document goes if its language is this uncertain, or cannot be told (no letters).
LEAST_POSTERIOR = 0.5
NEAR = 0.8
#: Ids that are sent to every task at most.
FEW_IDS = 2_000_000


def _aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """The documents with columns renamed that an operator would replace, and what brings the names back."""
    taken = [c for c in docs.columns if c.lower() in added]
    names = dict(zip(taken, unused(docs, *[f"{c}_own" for c in taken])))
    return docs.select(*[col(c).alias(names.get(c, c)) for c in docs.columns]), [col(names.get(c, c)).alias(c) for c in docs.columns]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Learns from all labels; a null or empty text is not toxic, and
    repeated rows share a verdict. All columns stay as they are, whatever their names."""
    base, back = _aside(docs, ("score", "predicted", "passages"))
    lexicon = toxicity.train(base, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(base, lexicon).filter("predicted = 0").select(*back)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. A null ``lang`` becomes the predicted one. Null and
    empty texts and those without letters go; repeated rows share a verdict. All other columns stay
    as they are, whatever their names."""
    base, back = _aside(docs, ("lang_pred", "score", "bits_per_byte"))
    model = language_id.train(base)
    told = language_id.predict_language(base, model).filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_POSTERIOR))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Of rows of one id whose
    texts have the same words one stays, others are judged by themselves; rows with a null id all
    stay, and so do texts without words of different ids."""
    verdict = stash(minhash.near_duplicates(docs, threshold=NEAR), "near")
    known = verdict.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = known.filter("not kept").select("doc_id")
        # up to FEW_IDS ids go to the documents; only beyond that are texts shuffled
        gone = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
        return docs.join(gone, "doc_id", "left_anti").select(*cols(docs.columns))
    (mark,) = unused(docs, "text_hash")
    one = known.filter("kept").groupBy("doc_id", "set_digest").agg(F.min("text_hash").alias(mark)).select("doc_id", mark).distinct()
    marked = docs.withColumn(mark, F.xxhash64("text")).join(one, ["doc_id", mark], "left_semi")
    row = F.struct(*cols(docs.columns))
    first = marked.groupBy("doc_id", mark).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return first.select(*cols(docs.columns)).unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their sizes, in a shuffled order. Null sources are one source,
    null ids share a number of copies, texts are not looked at."""
    return mixing.mix(docs).select(*cols(docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (little-endian unsigned 32-bit), n_tokens and round_trip, whether the
    ids decode to the text; columns of these names are replaced. Null and empty texts have none."""
    import public_tokenizers

    done = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=tuple(docs.columns), count=True, check=True)
    added = ["n_tokens", "ids", "round_trip"]
    return done.select(*cols([c for c in docs.columns if c.lower() not in added]), *added)


STAGES = [
    ("toxicity", keep_clean),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_copies),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
