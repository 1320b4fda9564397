"""Understanding tables of messages: spelling, abbreviations, entities, intents, context.

Dictionaries are parameters of bounded size and become expressions; only the
vocabulary of a catalog, which grows with data, is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions import text as tx
from larkfield.operators.ranking import keep_first, top_per_group

SIMILARITY = 0.84
SHORTEST = 4
#: Letters of a segment of a known word; follows from the similarity.
SEGMENT_LETTERS = range(3, 7)


def bare_words(text: Column) -> Column:
    """Words without accents."""
    return tx.words(tx.strip_accents(text))


def vocabulary_of(df: DataFrame, columns: Sequence[Column], min_letters: int = 3) -> DataFrame:
    """Distinct accent-free words of letters in the given columns."""
    words = F.flatten(F.array(*[bare_words(c) for c in columns]))
    return (df.select(F.explode(words).alias("word")).filter((F.length("word") >= min_letters) & F.col("word").rlike(r"^\p{L}+$"))
            .distinct())


def _most_edits(letters: Column) -> Column:
    """Edits that a word of this length can be away from a partner that is similar enough (rounding included)."""
    lost = 1 - SIMILARITY + 5e-7
    return F.floor(letters * (lost / (1 - lost)))


def _letters(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)(.)"), 1)


def _span(letters: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(letters, (start + 1).cast("int"), size.cast("int")), "")


def _known_segments(vocab: DataFrame) -> DataFrame:
    """``fixed, size, cell, text``: each known word cut into one segment more than edits are allowed.

    ``size`` is the word's length as a power of two; places are rounded to
    cells of a quarter of that power.
    """
    d = (vocab.select(F.col("word").alias("fixed"), _letters(F.col("word")).alias("_l")).withColumn("_n", F.size("_l"))
         .withColumn("_k", _most_edits(F.col("_n")) + 1).filter("_k > 1")
         .withColumn("size", F.length(F.bin("_n")) - 1).withColumn("_w", F.pow(F.lit(2), F.col("size") - 2)))
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1), lambda i: F.struct(
        F.floor(i * F.col("_n") / F.col("_k")).alias("a"), F.floor((i + 1) * F.col("_n") / F.col("_k")).alias("b")))
    return d.withColumn("_p", F.explode(parts)).select(
        "fixed", "size", F.floor(F.col("_p.a") / F.col("_w")).alias("cell"), _span(F.col("_l"), F.col("_p.a"), F.col("_p.b") - F.col("_p.a")).alias("text"))


def _asked_segments(words: DataFrame) -> DataFrame:
    """``word, size, cell, text``: every piece of a word that may be a segment of a similar known word."""
    d = words.select("word", _letters(F.col("word")).alias("_l")).withColumn("_n", F.size("_l")).withColumn("_d", _most_edits(F.col("_n")))
    sizes = F.sequence(F.length(F.bin(F.greatest(F.col("_n") - F.col("_d"), F.lit(SHORTEST)))) - 1, F.length(F.bin(F.col("_n") + F.col("_d"))) - 1)
    d = d.withColumn("size", F.explode(sizes)).withColumn("_w", F.pow(F.lit(2), F.col("size") - 2)).withColumn(
        "_far", _most_edits(F.pow(F.lit(2), F.col("size") + 1) - 1)).withColumn("_m", F.explode(F.array(*[F.lit(m) for m in SEGMENT_LETTERS])))
    d = d.filter("_m <= _n").withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_m"))))
    cells = F.sequence(F.floor(F.greatest(F.col("_a") - F.col("_far"), F.lit(0)) / F.col("_w")), F.floor((F.col("_a") + F.col("_far")) / F.col("_w")))
    return d.select("word", "size", _span(F.col("_l"), F.col("_a"), F.col("_m")).alias("text"), F.explode(cells).alias("cell"))


def corrections(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Nearest vocabulary word for unknown words of four letters or more: ``word, fixed, similarity``.

    Similarity is 1 - edit distance / longer length and must reach 0.84. A known
    word that is at most d edits away is cut into d + 1 segments, of which one
    must stand unchanged in the unknown word, at most d places further left or
    right. Pairs come from an equality join on such segments (three to six
    letters) with their rough place and the rough length of the known word, so
    no word meets the whole vocabulary, and rows grow with the letters of a
    word, whatever its length. (The edit ratio stands in for a matching-block ratio.)
    """
    unknown = words.select("word").distinct().filter(F.length("word") >= SHORTEST).join(vocab.select("word"), "word", "left_anti")
    pairs = _asked_segments(unknown).join(_known_segments(vocab.select("word").distinct()), ["size", "cell", "text"]).select("word", "fixed")
    longer = F.greatest(F.length("word"), F.length("fixed"))
    near = pairs.filter(F.abs(F.length("word") - F.length("fixed")) <= _most_edits(longer)).distinct()
    ratio = 1 - F.levenshtein("word", "fixed") / longer
    close = near.withColumn("similarity", F.round(ratio, 6)).filter(F.col("similarity") >= SIMILARITY)
    return keep_first(close, ["word"], [F.desc("similarity"), F.col("fixed")])


def corrected_text(df: DataFrame, key: str, text: str, fixes: DataFrame, typos: Mapping[str, str]) -> DataFrame:
    """Messages with known typos and near words put right: ``key, corrected``."""
    words = df.select(key, F.posexplode(tx.words(F.col(text))).alias("pos", "word"))
    joined = words.join(fixes.select("word", "fixed"), "word", "left")
    known = F.create_map(*[F.lit(x) for p in typos.items() for x in p]) if typos else None
    best = F.coalesce(*([known[F.col("word")]] if typos else []), F.col("fixed"), F.col("word"))
    # Words of one message meet again; a message is one row to begin with.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", best.alias("w")))), lambda x: x["w"])
    return joined.groupBy(key).agg(F.array_join(ordered, " ").alias("corrected"))


def expand_abbreviations(text: Column, table: Mapping[str, str], only_alone: Sequence[str] = ()) -> Column:
    """Text followed by the long forms of its abbreviations; ambiguous ones only when they stand alone."""
    toks = tx.words(F.regexp_replace(F.regexp_replace(text, r"(?i)c\+\+", "cpp"), r"(?i)c#", "csharp"))
    parts = [F.array_join(toks, " ")]
    for short, full in table.items():
        hit = F.array_contains(toks, short)
        if short in only_alone:
            hit = hit & (F.size(toks) == 1)
        parts.append(F.when(hit, F.lit(full)))
    return F.concat_ws(" ", *parts)


def expand_query(text: Column, aliases: Mapping[str, str], categories: Sequence[str], stop: Sequence[str]) -> Column:
    """Query with alias expansions, the categories it names, and its keywords said twice more."""
    norm, toks = tx.normalize_text(text), tx.words(text)
    parts = [text]
    for alias, long in aliases.items():
        parts.append(F.when(F.array_contains(toks, alias), F.lit(long)))
    for name in categories:
        low = " ".join(name.lower().split())
        words = F.array(*[F.lit(w) for w in low.split()])
        named = F.contains(norm, F.lit(low)) | (F.size(F.filter(F.array_intersect(toks, words), lambda w: F.length(w) > 3)) > 0)
        parts.append(F.when(named, F.lit(name)))
    keywords = F.array_join(tx.query_tokens(text, stop), " ")
    parts += [F.when(keywords != "", keywords), F.when(keywords != "", keywords)]
    return F.concat_ws(" ", *parts)


def match_entities(text: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """Names found in the text, the one with the longest matching alias first.

    Aliases of several words match as substrings, others as whole words; ones
    of less than three letters only when they are the whole text.
    """
    bare = tx.strip_accents(tx.normalize_text(text))
    toks = F.split(bare, " ")
    found = []
    for order, (name, options) in enumerate(aliases.items()):
        best = F.lit(0)
        for alias in sorted(options, key=len):
            if " " in alias:
                hit = F.contains(bare, F.lit(alias))
            else:
                hit = F.array_contains(toks, alias) & (F.lit(len(alias) >= 3) | (F.size(toks) == 1))
            best = F.when(hit, len(alias)).otherwise(best)
        found.append(F.struct((-best).alias("neg"), F.lit(order).alias("order"), F.lit(name).alias("name")))
    hits = F.filter(F.array(*found), lambda x: x["neg"] < 0)
    return F.transform(F.sort_array(hits), lambda x: x["name"])


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose pattern occurs in the bare text."""
    bare = tx.strip_accents(tx.normalize_text(text))
    out = None
    for label, pattern in rules:
        hit = bare.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default).cast("string"))


def clause_intents(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]],
                   aliases: Mapping[str, Sequence[str]], separator: str, most: int = 3) -> DataFrame:
    """Labels of the clauses of each message, when there are at least two different ones.

    A clause that fits no rule alone borrows the entity of the clauses before
    it. The first ``most + 2`` clauses are read and ``most`` labels are kept,
    as the feature defines.
    """
    clauses = F.filter(F.transform(F.split(F.col(text), separator), lambda c: F.trim(F.regexp_replace(c, r"^[ ,.]+|[ ,.]+$", ""))),
                       lambda c: c != "")
    long = (df.select(key, clauses.alias("_c")).filter(F.size("_c") >= 2)
            .select(key, F.posexplode(F.slice("_c", 1, most + 2)).alias("pos", "clause")))
    named = long.withColumn("entity", F.get(match_entities(F.col("clause"), aliases), F.lit(0)))
    # At most most + 2 clauses per message reach this window.
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lent = named.withColumn("lent", F.last("entity", ignorenulls=True).over(before))
    own = first_rule(F.col("clause"), rules)
    borrowed = first_rule(F.concat_ws(" ", "lent", "clause"), rules)
    labelled = lent.withColumn("intent", F.coalesce(own, F.when(F.col("lent").isNotNull(), borrowed))).filter("intent IS NOT NULL")
    firsts = labelled.groupBy(key, "intent").agg(F.min("pos").alias("pos"))
    kept = top_per_group(firsts, [key], [F.col("pos")], most, "place")
    several = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(key)
    return kept.join(several, key, "left_semi").select(key, "place", "intent", "pos")


def follow_up_context(df: DataFrame, key: str, turn: str, role: str, text: str, entity: Column, cue: str,
                      window: int = 4, messages: int = 2, longest: int = 8) -> DataFrame:
    """Short follow-ups get the last user messages put in front.

    A user message of up to ``longest`` words that names no entity, or holds a
    cue word, is prefixed by up to ``messages`` user messages among the
    ``window`` turns before it. Each message offers itself to the next turns
    by key, so a conversation of any length is spread over tasks.
    """
    lines = df.select(key, turn, role, text)
    offers = (lines.filter(F.col(role) == "user")
              .select(key, F.col(turn).alias("_at"), F.col(text).alias("_said"),
                      F.explode(F.sequence(F.col(turn) + 1, F.col(turn) + window)).alias(turn)))
    short = F.size(F.split(F.trim(text), r"\s+")) <= longest
    needs = short & (~entity | tx.strip_accents(F.lower(text)).rlike(cue))
    mine = lines.filter(F.col(role) == "user").withColumn("_needs", needs)
    near = offers.join(mine.filter("_needs").select(key, turn), [key, turn])
    said = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("_at", "_said")), asc=False), 1, messages), lambda x: x["_said"])
    context = near.groupBy(key, turn).agg(F.array_join(F.reverse(said), " ").alias("_context"))
    return mine.join(context, [key, turn], "left").select(
        key, turn, F.concat_ws(" ", F.nullif("_context", F.lit("")), text).alias("resolved"), F.col("_context").isNotNull().alias("prefixed"))


def add_noise(text: Column, seed: int, swap: float = 0.04, drop: float = 0.02) -> Column:
    """Accent-free text with seeded letter swaps and drops.

    Chance per letter comes from a hash of text, place and seed; a letter that
    was swapped back stays put, as swaps start at even places.
    """
    bare = tx.strip_accents(text)
    letters = F.split(bare, "")
    n = F.length(bare)

    def chance(i: Column) -> Column:
        return F.pmod(F.xxhash64(bare, i, F.lit(seed)), F.lit(1000000)) / 1000000

    def letter(i: Column) -> Column:
        # i counts from 0; a pair (2k, 2k + 1) swaps when its first place says so.
        first = i - i % 2
        swapped = (chance(first) < swap) & (first + 1 < n)
        source = F.when(swapped, F.when(i == first, i + 1).otherwise(first)).otherwise(i)
        dropped = ~swapped & (chance(i) >= swap) & (chance(i) < swap + drop)
        return F.when(dropped & (F.substring(bare, i + 1, 1) != " "), "").otherwise(F.substring(bare, source + 1, F.lit(1)))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), "")).otherwise("")


def natural_query(definition: Column, masked: Column, longest: int = 28) -> Column:
    """First sentence without the masked plain-letter words, at most ``longest`` words."""
    words = F.filter(F.transform(F.split(tx.first_sentence(definition), r"\s+"),
                                 lambda w: F.regexp_replace(w, r"""^[.,:;()"']+|[.,:;()"']+$""", "")), lambda w: w != "")
    kept = F.filter(words, lambda w: ~(w.rlike(r"^[\x00-\x7F]+$") & F.array_contains(masked, F.lower(w))))
    return F.array_join(F.slice(kept, 1, longest), " ")


def matched_keywords(query: Column, item: Column, stop: Sequence[str], most: int = 5) -> Column:
    """Query words that occur in the item text, or share a five-letter start with one of its words."""
    wanted = F.array_distinct(tx.drop_words(tx.words(query), stop, 3))
    hay, hay_words = tx.normalize_text(item), tx.words(item)
    starts = F.array_distinct(F.transform(F.filter(hay_words, lambda w: F.length(w) >= 5), lambda w: F.left(w, F.lit(5))))
    hit = F.filter(wanted, lambda w: F.contains(hay, w) | ((F.length(w) >= 5) & F.array_contains(starts, F.left(w, F.lit(5)))))
    return F.slice(hit, 1, most)
