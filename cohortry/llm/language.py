"""Language identification: known words first, then shorter and shorter character n-grams.

A word seen in training adds its log frequency in each language.  An unseen word is looked up by its character
n-grams, the longest length first; the first length with any known n-gram decides, and lengths below it are not
consulted.  The counts come from Spark over a bounded, documented share of the labelled rows, spread evenly by
hash; the model is a bounded table of words and n-grams that travels to the tasks that score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable, spare_name

TRAIN_ROWS = 6_000       # labelled rows per language that the model learns from, about
WORDS = 60_000           # most frequent words kept per language
GRAMS = 20_000           # most frequent n-grams kept per length and language
LENGTHS = (5, 4, 3, 2, 1)
LONGEST = 40             # characters of a word; longer runs are cut into words of this length
TOKEN = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
UNKNOWN = "und"
MEMO = 200_000           # unseen words whose scores a worker remembers


@dataclass
class LanguageModel:
    """Per-language log frequencies of words and n-grams; columns follow ``langs``."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[tuple[int, dict[str, int], np.ndarray]]
    memo: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def backoff(self, word: str) -> np.ndarray | None:
        """Scores of an unseen word: those of its known n-grams of the longest length that has any, averaged."""
        found = self.memo.get(word)
        if found is None:
            marked = f"_{word}_"
            found = ()
            for n, index, scores in self.grams:
                at = [i for i in map(index.get, (marked[k:k + n] for k in range(len(marked) - n + 1))) if i is not None]
                if at:
                    found = scores[at].mean(axis=0)
                    break
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return None if isinstance(found, tuple) else found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the probability; ``und`` and 0 where the text has no letter.

        Ties go to the language that comes first by name.
        """
        words = TOKEN.findall((text or "").lower())
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        at = list(map(self.words.get, words))
        known = [i for i in at if i is not None]
        total = self.word_scores[known].sum(axis=0) if known else np.zeros(len(self.langs))
        if len(known) < len(at):
            for word, i in zip(words, at):
                if i is None and (score := self.backoff(word)) is not None:
                    total = total + score
        total = total / np.sqrt(len(words))      # neighbouring words are no independent witnesses
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(1.0 / share.sum())


def _tokens(text: Column) -> Column:
    """The words of a text as :data:`TOKEN` finds them: letters only, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{1,%d}" % LONGEST), F.lit(0))


def _table(counts: DataFrame, langs: list[str], most: int, least: int = 1) -> tuple[dict[str, int], np.ndarray]:
    """The ``most`` most frequent keys per language, of those counted ``least`` times, with their smoothed log
    frequencies among all keys: a bounded number of rows."""
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    counts = counts.where(F.col("n") >= least)
    kept = None
    for lang in langs:
        part = counts.where(F.col("lang") == lang).orderBy(F.col("n").desc(), "key").limit(most).select("key")
        kept = part if kept is None else kept.unionByName(part)
    index: dict[str, int] = {}
    at, which, n = [], [], []
    for key, lang, count in counts.join(kept.distinct(), "key").toPandas()[["key", "lang", "n"]].itertuples(index=False):
        at.append(index.setdefault(key, len(index)))
        which.append(langs.index(lang))
        n.append(count)
    table = np.zeros((max(1, len(index)), len(langs)))
    table[at, which] = n
    all_n = np.array([totals.get(x, 0) for x in langs], float)
    return index, np.log((table + 0.5) / (all_n + 0.5 * max(1, len(index))))


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                         pick_col: str = "doc_id", train_rows: int = TRAIN_ROWS, words: int = WORDS,
                         grams: int = GRAMS) -> LanguageModel:
    """Learn from rows with text and language.  Of languages with more rows, about ``train_rows`` are used,
    picked by a hash of ``pick_col``, which has no other use.

    Languages are the distinct values of ``lang_col``; their number is taken to be small, as in any list of
    language codes.  Rows without language or text teach nothing.  No usable row gives a model that knows no
    language and answers ``und``.
    """
    rows = labelled.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"),
                           F.xxhash64(col(pick_col), F.lit("train")).alias("pick")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, np.zeros((1, 0)), [])
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_rows / sizes[k]))]), F.col("lang"))
    picked = rows.where(F.pmod("pick", F.lit(1_000_003)) < share * 1_000_003)
    # Frequency is the number of texts that hold a word: one long text that repeats itself has one say.
    seen = durable(picked.select("lang", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("key"))
                   .groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "words")
    index, scores = _table(seen, langs, words, 2)
    tables = []
    marked = F.concat(F.lit("_"), F.col("key"), F.lit("_"))
    for n in LENGTHS:
        pieces = F.filter(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.substring(marked, i, F.lit(n))),
                          lambda g: F.length(g) == n)
        # A word counts by its logarithm here: n-grams speak for words that were not seen, not for frequent ones.
        counted = (seen.select("lang", F.explode(pieces).alias("key"), F.log1p("n").alias("n")).groupBy("lang", "key")
                   .agg(F.sum("n").alias("n")))
        tables.append((n, *_table(durable(counted, "grams"), langs, grams)))
    return LanguageModel(langs, index, scores, tables)


def predictor(model: LanguageModel):
    """A column function: text to (lang_pred, score)."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify_language(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the probability of the prediction, 0 to 1); columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0.  Whole texts are read, at any length; rows
    that repeat are predicted alike; an empty table stays empty.
    """
    said = predictor(model)(col(text_col).cast("string"))
    name = spare_name(df, "__language")
    return (df.drop("lang_pred", "score").withColumn(name, said)
            .withColumns({"lang_pred": F.col(name)["lang_pred"], "score": F.col(name)["score"]}).drop(name))
