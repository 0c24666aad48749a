"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form that each word is a variant of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.llm.common import pick, staged

#: Letters of a word: A-Z, a-z and Latin-1 from U+00C0 on.
RUN = r"[A-Za-zÀ-ÿ]+"
#: A run of a document whose crc32 this divides loses a letter.
DAMAGE = 97
#: Code points and occurrences that a word needs.
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs so many times as often as its variant.
TIMES = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_counts(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of whole texts and how often they occur.

    Runs are counted per word before they are shuffled, so a word that holds a third of all rows is a row per task.
    """
    runs = pick(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    runs = runs.select("run", hashed.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("left(run, cast(h % char_length(run) as int))"), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(short, long, n_short, n_long): pairs of `words` (word, n; distinct words) that differ by one inserted, deleted or replaced code point,
    each once: first the shorter one, or of equal lengths the one that is smaller in code-point order.

    The first word is cut into two disjoint chunks, its halves. The second gives its grams of the lengths of such halves. An edit falls
    into one half; the other is found again in the second word: the first half at the same place, the second half moved by the
    difference of lengths, which is none or one. So a chunk is joined with the one gram that lies there. A pair that shares both halves counts by
    the first, so no pair comes twice, and the exact edit distance decides. Candidates are rows of one equi join: no list is gathered, and a hot half is a
    skewed join key that adaptive execution splits.
    """
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select(F.col("word").alias("short"), F.col("n").alias("n_short"), F.col("size").alias("length"), F.expr("""inline(array(
        struct(1 as half, left(word, cast(size / 2 as int)) as piece), struct(2 as half, substring(word, cast(size / 2 as int) + 1) as piece)))"""))
    grams = sized.select(F.col("word").alias("long"), F.col("n").alias("n_long"), "size", F.explode(F.array(F.col("size") - 1, F.col("size"))).alias("length"))
    grams = grams.where("length >= 1").select("long", "n_long", "length", F.expr("""inline(array(
        struct(1 as half, left(long, cast(length / 2 as int)) as piece), struct(2 as half, right(long, length - cast(length / 2 as int)) as piece)))"""))
    first = F.expr("half = 1 or left(short, cast(length / 2 as int)) <> left(long, cast(length / 2 as int))")
    order = F.expr("char_length(long) > length or short < long")
    found = chunks.join(grams, ["length", "half", "piece"]).where(order & first & (F.levenshtein("short", "long", 1) == 1))
    return found.select("short", "long", "n_short", "n_long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): forms followed to the last, by pointer doubling. Forms must not run in circles."""
    links = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """Words of `docs` (doc_id, text), and which more frequent spelling each is a variant of: (word, form, root, n, n_near, form_n).

    Words are runs of letters, A-Z in lower case; if `damage` divides the crc32 of `<doc_id>:<run>`, the run loses one letter (a planted misspelling;
    the crc32 also says which). A word has `min_length` code points and occurs `min_count` times. n_near counts the words one edit away; the form is
    the most frequent of them (ties: the smallest in code-point order) if it occurs at least `times` as often as the word (2 or more, so forms never run in circles), else NULL.
    root follows forms to the last; a word without a form is its own root.

    NULL and empty texts have no words; a NULL doc_id counts as the text null; repeated rows count each; other columns are ignored. Long texts
    are read whole. An empty table gives no rows. Text in which no word is frequent enough gives none either.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = staged(word_counts(docs, damage, min_length, min_count), "words")
    pairs = near_pairs(words)
    # Both directions come out of one pass over the join.
    both = pairs.select(F.expr("inline(array(struct(short as word, long as other, n_long as other_n), struct(long as word, short as other, n_short as other_n)))"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    named = words.join(best, "word", "left").withColumn("is_form", -F.col("best.rank") >= times * F.col("n"))
    named = staged(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best.other")).alias("form"),
                                F.when(F.col("is_form"), -F.col("best.rank")).alias("form_n")), "variants")
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
