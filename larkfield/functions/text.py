"""Text columns: normal forms, tokens, n-grams, cleaning. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words are a parameter everywhere; this short list is our own default.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "de des du et la le les un une der die das und von el los las y que en"
).split()


def _accent_table() -> tuple[str, str]:
    """Letters with marks and their bare letters, from Unicode decomposition."""
    marked, bare = [], []
    for low, high in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(low, high):
            char = chr(code).lower()
            base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
            if len(char) == 1 and len(base) == 1 and base != char and char not in marked:
                marked.append(char)
                bare.append(base)
    return "".join(marked) + "đ", "".join(bare) + "d"


ACCENTED, UNACCENTED = _accent_table()


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, everything but letters, digits, marks and ``_`` to spaces, squeezed.

    Input is expected in composed form; :func:`larkfield.operators.catalog.composed`
    repairs the rows that are not.
    """
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}_\s]", " "))


def strip_accents(text: Column) -> Column:
    """Lower case without marks; the barred d becomes a plain d."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, UNACCENTED), r"\p{Mn}", "")


def words(text: Column) -> Column:
    """Words of the normal form, in order (empty array for empty text)."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def drop_words(tokens: Column, stop: Sequence[str], min_length: int) -> Column:
    """Tokens of at least ``min_length`` letters that are not stop words."""
    banned = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(tokens, lambda w: (F.length(w) >= min_length) & ~F.array_contains(banned, w))


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Index tokens: words of two letters or more without stop words."""
    return drop_words(words(text), stop, 2)


def query_tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Query tokens: words of three letters or more without stop words."""
    return drop_words(words(text), stop, 3)


def with_ngrams(toks: Column, n: int = 3) -> Column:
    """The tokens followed by their 2..n-grams joined with ``_``.

    Grams are zipped from shifted copies, so ``toks`` is evaluated a fixed
    number of times however long the text is.
    """
    size = F.size(toks)

    def join(left: Column, right: Column) -> Column:
        return F.concat(left, F.lit("_"), right)

    def shifted(by: int, k: int) -> Column:
        return F.slice(toks, F.lit(by + 1), F.greatest(size - k + 1, F.lit(0)))

    parts = [toks]
    for k in range(2, n + 1):
        grams = shifted(0, k)
        for by in range(1, k):
            grams = F.zip_with(grams, shifted(by, k), join)
        parts.append(grams)
    return F.concat(*parts)


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character grams inside words padded with one space, over accent-free text."""
    padded = F.transform(words(strip_accents(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(word: Column, n: int) -> Column:
        last = F.length(word) - n + 1
        cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, n))
        return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        return F.concat(*[of_size(word, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, grams))


def text_list(text: Column, separator: str = ",") -> Column:
    """Distinct normal forms of a separated list."""
    parts = F.transform(F.split(text, separator), normalize_text)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def _list_literal(text: Column) -> Column:
    """Elements of a bracketed list written as text: quoted strings, else comma parts."""
    inner = F.regexp_replace(text, r"^\[|\]$", "")
    quoted = F.transform(F.regexp_extract_all(inner, F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(1)),
                         lambda x: F.regexp_replace(x, r"""^['"]|['"]$""", ""))
    return F.when(F.size(quoted) > 0, quoted).otherwise(F.split(inner, ","))


def _blank_word(text: Column) -> Column:
    return text.isNull() | (text == "") | (F.lower(text) == "nan")


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), ", ")


def clean_topics(text: Column) -> Column:
    """List literals and ``|``, ``;`` or ``/`` separated values as a comma list."""
    t = F.trim(text)
    plain = F.split(F.regexp_replace(t, r"[|;/]", ","), ",")
    return (F.when(_blank_word(t), F.lit(""))
            .when(t.rlike(r"(?s)^\[.*\]$"), _joined(_list_literal(t)))
            .otherwise(_joined(plain)))


def unwrap_list(text: Column) -> Column:
    """Names stored as list literals lose their brackets; other text is kept."""
    t = F.trim(text)
    return (F.when(_blank_word(t), F.lit(""))
            .when(t.rlike(r"(?s)^\[.*\]$"), _joined(_list_literal(t))).otherwise(t))


def clean_link(link: Column) -> Column:
    """http(s) links stay, anything else becomes empty."""
    t = F.trim(link)
    return F.when(t.rlike(r"(?i)^https?://"), t).otherwise("")


def collapse_repeats(text: Column, longest: int = 4) -> Column:
    """Phrases of up to ``longest`` words said several times in a row are said once.

    Longer phrases go first. One removal can bring equal phrases together, so rounds go on until
    nothing changes; every round but the last takes words away, so there are fewer rounds than words.
    """
    def once(t: Column) -> Column:
        for k in range(longest, 0, -1):
            lead = rf"(?:\S+ ){{{k - 1}}}" if k > 1 else ""
            t = F.regexp_replace(t, rf"(?iu)(?<!\S)({lead}\S+)(?: \1)+(?!\S)", "$1")
        return t

    def step(state: Column, _: Column) -> Column:
        # The one-element array gives the new text a name, so that it is made once.
        moved = F.transform(F.array(once(state["t"])), lambda new: F.struct(new.alias("t"), (new == state["t"]).alias("still")))
        return F.when(state["still"], state).otherwise(F.get(moved, F.lit(0)))

    start = squeeze(text)
    rounds = F.sequence(F.lit(0), F.size(F.split(start, " ")))
    return F.when(text.isNotNull(), F.aggregate(rounds, F.struct(start.alias("t"), F.lit(False).alias("still")), step, lambda s: s["t"]))


#: Kinds of characters in running text.
KINDS = {"word": r"[\p{L}\p{N}]", "letter": r"\p{L}", "capital": r"\p{Lu}", "open": r"[(\[{«“]", "close": r"[)\]}»”]",
         "pause": r"[,;:]", "end": r"[.!?…]", "stop": r"(?<=[\p{Ll}\p{N})\]}»”])[.!?…]"}
#: Pairs of neighbours that take one blank, and pairs that take none; all others stay as they were written.
APART = (("pause", "letter"), ("stop", "capital"), ("close", "letter"))
TOGETHER = (("word", "pause"), ("word", "end"), ("word", "close"), ("close", "pause"), ("close", "end"), ("open", "word"))


def spaced(text: Column, apart: Sequence[tuple[str, str]] = APART, together: Sequence[tuple[str, str]] = TOGETHER) -> Column:
    """Blanks between neighbouring characters by the tables of pairs of kinds; links stay as they are."""
    def word(one: Column) -> Column:
        for left, right in apart:
            one = F.regexp_replace(one, f"({KINDS[left]})({KINDS[right]})", "$1 $2")
        return one

    out = F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w.contains("://"), w).otherwise(word(w))), " ")
    for left, right in together:
        out = F.regexp_replace(out, f"({KINDS[left]}) +({KINDS[right]})", "$1$2")
    return out


def clean_display(text: Column) -> Column:
    """Readable text: no stuttering, blanks at signs by the tables of :func:`spaced`, capital start."""
    shown = squeeze(spaced(collapse_repeats(text)))
    return F.concat(F.upper(F.left(shown, F.lit(1))), F.substring(shown, 2, 2147483647))


# Named entities that pages use most; the ampersand comes last so that
# nothing is decoded twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Visible text of a page: no comments, scripts or styles, tags as spaces, entities decoded."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return squeeze(t)


# Signs removed from review texts before classification.
REVIEW_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_review(text: Column, signs: str = REVIEW_SIGNS) -> Column:
    """Lower case without links, tags, the given signs and pictographs."""
    t = F.regexp_replace(F.lower(text), r"http\S+", "")
    t = F.regexp_replace(t, r"<[^>]*?>", "")
    t = F.translate(t, signs, "")
    t = squeeze(t)
    return F.trim(F.regexp_replace(t, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+", ""))


def first_sentence(text: Column) -> Column:
    """Text up to the first full stop followed by a space."""
    return F.split(text, r"\. ")[0]


def video_id(url: Column) -> Column:
    """Video id of a link to a video page or its short form, or the bare id: eleven letters, digits, ``_`` or ``-``.

    Short hosts carry the id as the path; video pages carry it in the query or after a folder of the path.
    """
    link = F.trim(url)
    whole = F.when(link.contains("://"), link).otherwise(F.concat(F.lit("https://"), link))
    host = F.regexp_replace(F.lower(F.try_parse_url(whole, F.lit("HOST"))), r"^(www|m)\.", "")
    path = F.split(F.try_parse_url(whole, F.lit("PATH")), "/")
    named = F.when(F.lower(F.get(path, F.lit(1))).isin("embed", "shorts", "v"), F.get(path, F.lit(2)))
    found = (F.when(host == "youtu.be", F.get(path, F.lit(1)))
             .when(host == "youtube.com", F.coalesce(F.try_parse_url(whole, F.lit("QUERY"), F.lit("v")), named))
             .when(~link.contains("/") & ~link.contains("."), link))
    return F.when(found.rlike(r"^[\w-]{11}$"), found)
