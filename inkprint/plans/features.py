"""From pairs to features as one plan: normalise, mask, annotate, featurise, align.

A text's term counts, weights and statistics stay in the row of its side; the
sides of a pair meet once, by pair_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.lexicon import function_words
from inkprint.functions.masking import mask_all
from inkprint.functions.readability import INDICES, add_readability
from inkprint.functions.text import normalize
from inkprint.operators import annotate, audit, pairwise, sparse, stats, terms
from inkprint.sources import tables

Annotator = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FeatureConfig:
    least_words: int | None = 150
    most_words: int | None = 2000
    form: str = "NFC"
    lemmas: terms.TermConfig = field(default_factory=lambda: terms.LEMMAS)
    chars: terms.TermConfig = field(default_factory=lambda: terms.CHARS)
    pos: terms.TermConfig = field(default_factory=lambda: terms.POS)
    char_n: int = 4
    #: A file of function words; without one the list that comes with Spark.
    function_list: str | None = None

    @property
    def terms(self) -> dict[str, terms.TermConfig]:
        return {"tfidf": self.lemmas, "char_ngrams": self.chars, "pos_ngrams": self.pos}


KEYS = ["pair_id", "split", "side"]
FAMILIES = ("statistical", "tfidf", "char_ngrams", "pos_ngrams", "readability")


def masked_sides(pairs: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Long rows with the normalised text and, as ``text``, the rule-masked one."""
    long = audit.sides(pairs).withColumn("normalized", normalize(F.col("text"), config.form))
    return long.withColumn("text", mask_all(F.col("normalized")))


def annotated(long: DataFrame, annotator: Annotator = annotate.records) -> DataFrame:
    """Records of the rule-masked text by ``annotator``, and the text with entities masked too as ``masked``.

    Records describe the text before entity masking; character n-grams and
    readability read the text after it.
    """
    made = annotator(long)
    return made.withColumn("masked", annotate.entity_mask(F.col("text"), F.col("ents")))


def mask_text(spark: SparkSession, text: str, annotator: Annotator = annotate.records) -> tuple[str, dict]:
    """One text with its entities masked, and its record."""
    row = annotated(spark.createDataFrame([(text,)], "text string"), annotator).first()
    return row["masked"], {c: row[c] for c in ("tokens", "sentences", "chunks", "ents")}


def annotate_columns(pairs: DataFrame, folder: str, config: FeatureConfig = FeatureConfig(), annotator: Annotator = annotate.records) -> DataFrame:
    """Records of both columns, each written to ``folder`` as soon as it is annotated.

    A column whose table is there already is read instead, so a run that broke
    off goes on where it was; this table is the record cache of later steps.
    """
    long, done = masked_sides(pairs, config), []
    spark = pairs.sparkSession
    for side in ("text1", "text2"):
        path = f"{folder}/{side}"
        if not tables.exists(spark, f"{path}/_SUCCESS"):
            annotated(long.where(F.col("side") == side), annotator).write.mode("overwrite").parquet(path)
        done.append(spark.read.parquet(path))
    return done[0].unionByName(done[1])


def corpora(records: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """KEYS and the text that each term family is fitted on: content lemmas, character n-grams and parts of speech, joined by blanks."""
    lemmas = terms.content_lemmas(F.col("tokens"), function_words(config.function_list))
    made = {"tfidf": lemmas, "char_ngrams": terms.char_grams(F.col("masked"), config.char_n), "pos_ngrams": terms.pos_sequence(F.col("tokens"))}
    return records.select(*KEYS, *(F.array_join(c, " ").alias(f) for f, c in made.items()))


def save_artifacts(records: DataFrame, vocabs: dict[str, DataFrame], folder: str, config: FeatureConfig = FeatureConfig()) -> None:
    """Corpora, one directory a split, and the vocabularies."""
    tables.write_stage(corpora(records, config), folder, "corpora")
    for family, vocab in vocabs.items():
        vocab.write.mode("overwrite").parquet(f"{folder}/vocabulary/{family}")


def counted(records: DataFrame, config: FeatureConfig = FeatureConfig(), keep: tuple[str, ...] = (), digits: int | None = 5) -> DataFrame:
    """KEYS, the counts of the three term families, readability and ``keep`` of each side."""
    made = {
        "tfidf": (terms.content_lemmas(F.col("tokens"), function_words(config.function_list)), sparse.runs(1, 2)),
        "char_ngrams": (F.col("masked"), sparse.grams(config.char_n)),
        "pos_ngrams": (terms.pos_sequence(F.col("tokens")), sparse.runs(2, 3)),
    }
    # the records stay behind here: only the counts and the texts go on
    rows = records.select(*KEYS, *dict.fromkeys(("masked", *keep)), sparse.all_counts(made).alias("_counts"))
    rows = add_readability(rows, "masked", digits)
    return rows.select(*KEYS, *keep, *(F.col("_counts")[f].alias(f) for f in made), _dense([f"readability_{k}" for k in INDICES]).alias("readability"))


def _dense(names: list[str]) -> Column:
    """Numbers as a column of weights."""
    values = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    return F.struct(F.array(*(F.lit(i) for i in range(len(names)))).alias("idx"), F.array(*values).alias("weight"))


def statistics(records: DataFrame, config: FeatureConfig = FeatureConfig(), digits: int | None = 3) -> DataFrame:
    """KEYS and the statistics as a column of weights."""
    made = stats.document_statistics(records, KEYS, function_words(config.function_list), digits)
    return made.select(*KEYS, _dense(list(stats.NAMES)).alias("statistical"))


def vocabularies(counts: DataFrame, config: FeatureConfig = FeatureConfig()) -> dict[str, DataFrame]:
    """A vocabulary for each family, from training texts; a text in several pairs counts in each."""
    train = counts.where("split = 'train'")
    n = train.count()
    return {f: sparse.fit(train, f, n, c) for f, c in config.terms.items()}


def weighted(counts: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    """Rows of ``counted`` with weights in place of the counts."""
    for family, vocab in vocabs.items():
        counts = sparse.weights(counts, family, vocab, "_w", KEYS).drop(family).withColumnRenamed("_w", family)
    return counts


def sides(counts: DataFrame, statistical: DataFrame, vocabs: dict[str, DataFrame]) -> DataFrame:
    """All families of each side as columns of weights."""
    return weighted(counts, vocabs).join(statistical, KEYS)


def pair_features(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Pairs with the global features of each family; 0 where a pair has no text."""
    wide = pairwise.global_columns(pairwise.paired(made, list(FAMILIES)), pairwise.GLOBAL)
    return pairs.join(wide.select("pair_id", *GLOBAL), "pair_id", "left").na.fill(0.0, list(GLOBAL))


GLOBAL = tuple(f"{f}_{d}" for f in pairwise.GLOBAL for d in pairwise.DISTANCE_NAMES)
