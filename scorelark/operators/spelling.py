"""Spelling against a vocabulary, which is a parameter: words that nothing explains.

Words that the vocabulary has go before anything is gathered, so what is
shuffled is the unknown words of a document. A vocabulary of up to ``SENT``
words is sent to all tasks; a larger one is joined by word, on the words of a
document, and the session's handling of skew spreads a word that all have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx

SENT = 2_000_000
# ---- fixed values ----
#: Letters of any script, with inner digits, strokes and apostrophes.
TOKEN = r"\p{L}[\p{L}\p{N}_'-]*\p{L}|\p{L}"
#: Addresses are no words.
ADDRESS = r"(?i)\b[\w.+-]+@[\w.-]+\b|\bhttps?://\S+|\bwww\.\S+|\b[\w-]+\.(?:com|org|net|edu|io|ai|co|gov|ca|uk|dev|me)(?:/[^\s|,;]*)?"
# ---- end of the fixed values ----
SHORTEST, STEM, DERIVED, RED_FROM = 3, 4, 5, 4


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))).alias("word")).distinct()


def sent(words: DataFrame) -> DataFrame:
    """``words``, to be sent to all tasks if they are no more than ``SENT``."""
    return F.broadcast(words) if words.limit(SENT + 1).count() <= SENT else words


def colour(form: Column) -> Column:
    """red, which costs, or yellow, to be looked at again: a capital anywhere, or too short to be more than a fragment."""
    bare = F.regexp_replace(form, r"^[-']+|[-']+$", "")
    return F.when(form != F.lower(form), "yellow").when(F.length(bare) >= RED_FROM, "red").otherwise("yellow")


def candidates(word: Column) -> Column:
    """The words that a word may be derived from, or be made of: arrays of words that all have to be known."""
    n = F.length(word)
    left = lambda k: F.substring(word, F.lit(1), n - k)
    out = []
    for ending in lx.SUFFIXES:
        k = len(ending)
        stems = [left(k)] + ([F.concat(left(k), F.lit("e")), F.concat(left(k), F.lit("y")), left(k + 1)] if ending[0] in "aeiouy" else [])
        fit = word.endswith(ending) & (n - k >= STEM)
        out += [F.when(fit & (F.length(x) >= STEM), F.array(x)) for x in stems]
    for beginning in lx.BEGINNINGS:
        out.append(F.when(word.startswith(beginning) & (n - len(beginning) >= STEM), F.array(F.substring(word, F.lit(len(beginning) + 1), n))))
    cuts = F.when(n >= STEM + 3, F.transform(F.sequence(F.lit(STEM), n - 3), lambda i: F.array(F.substring(word, F.lit(1), i), F.substring(word, i + 1, n))))
    return F.when(n >= DERIVED, F.concat(F.array_compact(F.array(*out)), F.coalesce(cuts, F.array().cast("array<array<string>>")))).otherwise(F.array().cast("array<array<string>>"))


def explained(words: DataFrame, known: DataFrame, parts: Column) -> DataFrame:
    """The distinct ``word`` s of which some array in ``parts`` has known words only."""
    each = words.select("word").distinct().select("word", F.explode(parts).alias("p")).distinct()
    pieces = each.select("word", "p", F.explode("p").alias("piece"))
    there = pieces.join(sent(known.select(F.col("word").alias("piece")).distinct().withColumn("there", F.lit(True))), "piece", "left")
    return there.groupBy("word", "p").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all")).where("all").select("word").distinct()


def derivable(words: DataFrame, known: DataFrame) -> DataFrame:
    """The words (``word``) that are a regular form or a compound of known ones."""
    return explained(words, known, candidates(F.col("word")))


def forms(docs: DataFrame, known: DataFrame, names: DataFrame | None = None, text_col: str = "text", commonwealth: bool = True) -> DataFrame:
    """``doc_id``, ``word``, ``n``, ``first``, ``form``: the words of three letters or more that are neither listed, nor names, nor compounds of known parts."""
    known = known.select("word").distinct()
    cleaned = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ADDRESS, " ")
    tok = docs.select("doc_id", F.posexplode(F.regexp_extract_all(cleaned, F.lit(TOKEN), F.lit(0))).alias("pos", "w"))
    # a token begins and ends with a letter, so nothing is left to strip
    tok = tok.select("doc_id", "pos", "w", F.lower("w").alias("word")).where((F.length("word") >= SHORTEST) & ~F.col("word").contains("_"))
    fine = [*lx.MONTHS, *lx.MONTHS_SHORT, *lx.NEVER_UNKNOWN, *(lx.COMMONWEALTH if commonwealth else ())]
    always = F.col("word").isin(*lx.ALWAYS_UNKNOWN)
    listed = sent(known.where(~F.col("word").isin(*lx.ALWAYS_UNKNOWN)))
    tok = tok.where(always | ~F.col("word").isin(*fine)).join(listed, "word", "left_anti")
    if names is not None:
        tok = tok.join(names.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_anti")
    found = tok.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("w", "pos").alias("form"))
    # a compound is a row for each part that has to be known; any other word, and its row here, has a part that never is
    apart = F.filter(F.split("word", r"[-'/]"), lambda p: p != "")
    free = F.filter(apart, lambda p: (F.length(p) >= SHORTEST) & ~p.isin(*lx.BEGINNINGS, *lx.SUFFIXES))
    compound = F.when(F.col("word").rlike(r"[-'/]") & ~always, F.size(apart) > 1).otherwise(F.lit(False))
    parts = F.when(compound, free).otherwise(F.array(F.concat(F.lit("\0"), F.col("word"))))
    pieces = found.select("*", F.explode(parts).alias("piece"))
    there = sent(known.select(F.col("word").alias("piece")).withColumn("there", F.lit(True)))
    # the words are dealt by document and word already, so this takes no exchange; a compound without such parts has no row, and passes
    judged = pieces.join(there, "piece", "left").groupBy("doc_id", "word").agg(*(F.first(c).alias(c) for c in ("n", "first", "form")), F.bool_and(F.coalesce("there", F.lit(False))).alias("passes"))
    return judged.where(~F.col("passes")).drop("passes")


def unknown(docs: DataFrame, known: DataFrame, names: DataFrame | None = None, text_col: str = "text", strict: bool = True, commonwealth: bool = True) -> DataFrame:
    """Words of three letters or more that nothing explains: ``doc_id``, ``form``, ``n``, ``colour``, ``first``.

    ``known`` is the vocabulary with the words that are never asked about; ``names``
    (``doc_id``, ``word``) are a document's own. Compounds pass if each part is
    known, short, or an ending or beginning. Without ``strict``, so do words that
    look technical, names, and forms of known words. The first form of a word
    stands for it; plurals go with their singular: the longest form stays, the first on a tie.
    """
    found, always = forms(docs, known, names, text_col, commonwealth), F.col("word").isin(*lx.ALWAYS_UNKNOWN)
    if not strict:
        technical = F.col("form").rlike(r"[0-9]") | F.substring("form", 2, 200).rlike("[A-Z]") | (F.col("form") == F.upper("form")) & (F.length("form") <= 6)
        name = F.col("form").rlike(r"^\p{Lu}") & (F.substring("form", 2, 200) == F.lower(F.substring("form", 2, 200)))
        found = found.where(always | ~technical & ~name)
        found = found.join(derivable(found.where(~always), known), "word", "left_anti")
    merged = found.groupBy("doc_id", F.regexp_replace("word", "s+$", "").alias("stem")).agg(F.sum("n").alias("n"), F.max_by(F.struct("form", "first"), F.struct(F.length("form"), -F.col("first"))).alias("x"))
    return merged.select("doc_id", F.col("x.form").alias("form"), "n", colour(F.col("x.form")).alias("colour"), F.col("x.first").alias("first"))


def score(found: DataFrame, most: float = 3.0) -> DataFrame:
    """A point less for every red word, down to none."""
    out = found.groupBy("doc_id").agg(F.count_if(F.col("colour") == "red").alias("n_red"), F.count_if(F.col("colour") == "yellow").alias("n_yellow"))
    return out.withColumn("points", F.greatest(F.lit(0.0), most - F.col("n_red")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The affix rules of a hunspell ``.aff`` file: ``kind`` (PFX or SFX), ``flag``, ``strip``, ``add``, ``condition``, ``crosses``."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where((F.size("p") >= 4) & F.get("p", F.lit(0)).isin("PFX", "SFX"))
    part = lambda k: F.get("p", F.lit(k))
    header = part(2).isin("Y", "N") & (F.size("p") == 4) & part(3).rlike("^[0-9]+$")
    plain = lambda c: F.when(c == "0", "").otherwise(c)
    heads = parts.where(header).select(part(0).alias("kind"), part(1).alias("flag"), (part(2) == "Y").alias("crosses")).groupBy("kind", "flag").agg(F.max("crosses").alias("crosses"))
    rules = parts.where(~header).select(part(0).alias("kind"), part(1).alias("flag"), plain(part(2)).alias("strip"), plain(F.get(F.split(part(3), "/"), F.lit(0))).alias("add"), F.coalesce(part(4), F.lit(".")).alias("condition"))
    return rules.join(F.broadcast(heads), ["kind", "flag"], "left").withColumn("crosses", F.coalesce("crosses", F.lit(False)))


def read_stems(spark: SparkSession, path: str, compound_only: str = "c") -> DataFrame:
    """The words of a hunspell ``.dic`` file with their ``flags``; the count in front, words with other signs, and words for compounds only are left out."""
    entry = F.split(F.trim("value"), "\t")[0]
    both = spark.read.text(path).select(F.split(entry, "/").alias("p"))
    words = both.select(F.lower(F.trim(F.get("p", F.lit(0)))).alias("word"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("flags"))
    return words.where(F.col("word").rlike(r"^[\p{L}'.-]*\p{L}[\p{L}'.-]*$") & ~F.col("flags").contains(compound_only))


def _applied(words: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """``word`` (what the rules of a kind make), ``flags`` of its stem; words come with ``flags``."""
    own = rules.where(F.col("kind") == kind)
    each = words.select("word", "flags", F.explode(F.split("flags", "")).alias("flag")).join(F.broadcast(own), "flag")
    if kind == "SFX":
        fit, made = "(condition = '.' OR word rlike concat('(?:', condition, ')$')) AND endswith(word, strip)", "concat(substring(word, 1, length(word) - length(strip)), add)"
    else:
        fit, made = "(condition = '.' OR word rlike concat('^(?:', condition, ')')) AND startswith(word, strip)", "concat(add, substring(word, length(strip) + 1))"
    return each.where(F.expr(fit)).select(F.expr(made).alias("word"), "flags")


def affix_forms(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """The vocabulary that flagged stems (``word``, ``flags``) and rules make, without repeats: stems, endings, beginnings, and beginnings that cross before endings.

    Rules without a ``kind`` are endings; the rules of a language are a few thousand at most, so they are sent to all tasks.
    """
    if "kind" not in rules.columns:
        rules = rules.withColumns({"kind": F.lit("SFX"), "crosses": F.lit(False)})
    stems = stems.select(F.lower("word").alias("word"), "flags")
    ended = _applied(stems, rules, "SFX")
    made = [stems, ended, _applied(stems, rules, "PFX"), _applied(ended, rules.where("crosses"), "PFX")]
    return reduce(DataFrame.unionByName, (m.select("word") for m in made)).where("word <> ''").distinct()


def word_list(words: DataFrame, path: str) -> None:
    """Write the distinct words in order, one a line, as text."""
    words.select("word").distinct().orderBy("word").write.mode("overwrite").text(path)
