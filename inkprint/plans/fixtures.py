"""Pair, record and score tables over the driver's tables, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.operators import annotate
from inkprint.sources.tables import read_table


#: A pair's id is this times the id of its first text and that of its second.
PAIR = 10_000_000


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("lang = 'en'")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents paired with the one 20 and the one 1 further on; every seventh of the former again with sides swapped."""
    en = english(spark, sf_dir).select("doc_id", "text", "source")
    other = en.select(F.col("doc_id").alias("id2"), F.col("text").alias("text2"), F.col("source").alias("source2"))
    steps = en.withColumn("id2", F.explode(F.array(F.col("doc_id") + 20, F.col("doc_id") + 1))).join(other, "id2")
    made = steps.select(F.col("doc_id").alias("id1"), "id2", F.col("text").alias("text1"), "text2", (F.col("source") == F.col("source2")).cast("int").alias("same"))
    far = made.where("id2 = id1 + 20 and id1 % 7 = 0")
    swapped = far.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.col("text2").alias("text1"), F.col("text1").alias("text2"), F.lit(1).alias("same"))
    split = F.when(F.col("id1") % 10 < 7, "train").when(F.col("id1") % 10 < 8, "validation").otherwise("test")
    return made.unionByName(swapped).select((F.col("id1") * PAIR + F.col("id2")).alias("pair_id"), split.alias("split"), "text1", "text2", "same")


PAIRS_SQL = """
e as (select doc_id, text, source from documents where lang = 'en'),
q as (
  select a.doc_id id1, b.doc_id id2, a.text text1, b.text text2, case when a.source = b.source then 1 else 0 end same
  from e a join e b on b.doc_id = a.doc_id + 20
  union all
  select a.doc_id, b.doc_id, a.text, b.text, case when a.source = b.source then 1 else 0 end from e a join e b on b.doc_id = a.doc_id + 1
  union all
  select b.doc_id, a.doc_id, b.text, a.text, 1 from e a join e b on b.doc_id = a.doc_id + 20 where a.doc_id % 7 = 0
),
p as (
  select id1 * 10000000 + id2 pair_id, case when id1 % 10 < 7 then 'train' when id1 % 10 < 8 then 'validation' else 'test' end split, text1, text2, same from q
)
"""

GOLDEN_WORDS = "The big dog barked . It ran into town ."
GOLDEN_POS = "DET ADJ NOUN VERB PUNCT PRON VERB ADP NOUN PUNCT"
GOLDEN_DEP = "det amod nsubj ROOT punct nsubj ROOT prep pobj punct"


def golden_record(spark: SparkSession) -> DataFrame:
    """One hand-written record of two sentences, and one without tokens."""
    rows = [
        {
            "text": w,
            "lower": w.lower(),
            "lemma": w.lower(),
            "pos": p,
            "dep": d,
            "is_punct": p == "PUNCT",
            "is_space": False,
        }
        for w, p, d in zip(GOLDEN_WORDS.split(), GOLDEN_POS.split(), GOLDEN_DEP.split())
    ]
    spans = lambda *x: [{"start": a, "end": b} for a, b in x]
    data = [(1, rows, spans((0, 5), (5, 10)), spans((0, 3), (5, 6), (8, 9)), []), (2, [], [], [], [])]
    return spark.createDataFrame(data, f"id int, {annotate.RECORD}")


def word_records(docs: DataFrame) -> DataFrame:
    """Each word a token: its own lower-case lemma, a part of speech by its length, signs alone are punctuation."""
    from inkprint.functions.text import words

    pos = lambda w: F.element_at(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("ADP")), (F.length(w) % 3 + 1).cast("int"))
    token = lambda w: F.struct(
        w.alias("text"), F.lower(w).alias("lower"), F.lower(w).alias("lemma"), pos(w).alias("pos"), F.lit("dep").alias("dep"), w.rlike(r"^\p{P}+$").alias("is_punct"), F.lit(False).alias("is_space")
    )
    return docs.withColumn("tokens", F.transform(words(F.col("text")), token))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score made from the document's length."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read_table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 4000.0), 5).alias("score"))


SCORED_SQL = "s as (select doc_id, quality as label, round(least(1.0::double, n_chars / 4000.0::double), 5) as score from labels join documents using (doc_id))"
