"""Text functions: columns in, a column out."""

from __future__ import annotations

import html
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import lexicon as L

# fixed values: what counts as white space in texts of any script
ANY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def squeezed(text: Column) -> Column:
    """Every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_key(text: Column) -> Column:
    """Squeezed and in lower case."""
    return F.lower(squeezed(text))


def compact_key(name: Column) -> Column:
    """Lower-case letters and digits alone, for names of companies."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def loose_key(name: Column) -> Column:
    """Separators of identifiers as spaces, squeezed, in lower case."""
    return normal_key(F.regexp_replace(name, "[-_/.]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens of at least three characters without stopwords, in order, repeats kept.

    The text is split at what no token holds and the marks that none starts with, which gives
    the matches of TOKEN in time linear in the text; regexp_extract_all copies it for every match.
    """
    found = F.split(F.concat(F.lit(" "), F.lower(text)), L.BETWEEN_TOKENS)
    return F.filter(found, lambda t: (F.length(t) >= L.MIN_TOKEN) & ~t.isin(L.STOPWORDS))


def has_token(text: Column) -> Column:
    """Whether a text has any of ``tokens``; looks no further than the first."""
    mark, known = L.TOKEN_CHARS, "|".join(L.STOPWORDS)
    return F.lower(text).rlike(rf"(?:^|[^{mark}])[+#.\-]*+(?!(?:{known})(?![{mark}]))[a-z0-9][{mark}]{{{L.MIN_TOKEN - 1}}}")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text: one pattern, as code of a test for each word outgrows what the JVM compiles."""
    return text.rlike("|".join(map(re.escape, words)))


def verbatim_in(needle: Column, haystack: Column) -> Column:
    """Whether a needle that isn't blank stands in the haystack exactly, apart from white space."""
    return (squeezed(needle) != "") & F.contains(squeezed(haystack), squeezed(needle))


def looks_like_artifact(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in L.ARTIFACTS))


def problem_reasons(text: Column) -> Column:
    """Why a text is no problem statement: empty, too_short, artifact, names_file; an empty array if it is one."""
    return F.array_compact(
        F.array(
            F.when(squeezed(text) == "", "empty"),
            F.when((squeezed(text) != "") & (F.size(F.split(squeezed(text), " ")) < 6), "too_short"),
            F.when(looks_like_artifact(text), "artifact"),
            F.when(text.rlike(r"(?i)\b[\w-]+\.(?:md|txt|csv|json|py)\b"), "names_file"),
        )
    )


# --- statements ------------------------------------------------------------------


def sentences(line: Column) -> Column:
    """A line parted after ``.``, ``!`` or ``?`` where white space and a capital or digit follow."""
    return F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9])")


def has_metric(text: Column) -> Column:
    return text.rlike(L.METRIC)


def result_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, L.RESULT_PIECES), F.coalesce(*[F.when(low.rlike(pattern), name) for name, pattern in L.RESULT_TYPES]))


def is_outcome(text: Column) -> Column:
    low = F.lower(text)
    words = F.split(low, "[^a-z-]+")
    verb = F.arrays_overlap(words, F.lit(L.OUTCOME_VERBS))
    return result_type(text).isNotNull() | (has_metric(text) & verb) | (any_of(low, L.QUALITATIVE) & ~has_metric(text))


def result_kind(text: Column) -> Column:
    return F.when(~is_outcome(text), "missing").when(has_metric(text), "quantified").otherwise("qualitative_evidenced")


def is_work(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, "^[A-Za-z-]+", 0)).isin([*L.WORK_VERBS, *L.OUTCOME_VERBS])


def _first_tag(text: Column, families: list[tuple[str, list[str]]]) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(any_of(low, words), name) for name, words in families])


def cost_dimension(text: Column) -> Column:
    return _first_tag(text, L.COSTS)


def inefficiency(text: Column) -> Column:
    return _first_tag(text, L.INEFFICIENCIES)


def pain_tags(text: Column) -> Column:
    """Every tag whose words occur, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(low, words), name) for name, words in [*L.COSTS, *L.INEFFICIENCIES]])))


def resolves(outcome: Column, declared: Column) -> Column:
    """The first declared tag that the outcome's words point to, else the first tag at all, else null."""
    low = F.lower(outcome)
    families = [*L.COSTS, *L.INEFFICIENCIES]
    own = F.filter(declared, lambda d: reduce(lambda a, b: a | b, [(d == name) & any_of(low, words) for name, words in families]))
    return F.coalesce(F.get(own, F.lit(0)), _first_tag(outcome, families))


def tools(text: Column) -> Column:
    """Known tools that stand alone in the text, in the order of the list."""
    known = F.create_map(*(F.lit(x) for t in L.TOOLS for x in (t.lower(), t)))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?:^|[^\w-])({'|'.join(t.lower() for t in L.TOOLS)})(?=$|[^\w-])"), F.lit(1))
    return F.transform(F.array_intersect(F.lit([t.lower() for t in L.TOOLS]), F.coalesce(found, F.array().cast("array<string>"))), lambda t: F.element_at(known, t))


def role(text: Column, label: Column) -> Column:
    """outcome, work, problem or ignored; a label decides first."""
    problem = cost_dimension(text).isNotNull() | inefficiency(text).isNotNull()
    return (
        F.when(label == "problem", F.when(problem, "problem").otherwise("ignored"))
        .when(label == "action", "work")
        .when(label == "result", F.when(is_outcome(text), "outcome").otherwise("ignored"))
        .when(is_outcome(text), "outcome")
        .when(is_work(text), "work")
        .when(problem, "problem")
        .otherwise("ignored")
    )


# --- numbers ---------------------------------------------------------------------


def number_tokens(text: Column) -> Column:
    """Digits without commas and number words, distinct."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(L.DIGITS), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(L.NUMBER_WORDS))
    return F.array_distinct(F.concat(digits, words))


def number_value(token: Column) -> Column:
    """A digit token as a number with its K, M or B multiplied out; null for words."""
    bare = F.lower(F.regexp_replace(token, r"^\$|,|%$", ""))
    number = F.regexp_replace(bare, "[kmb]$", "").try_cast("decimal(28,6)")
    times = F.when(bare.endswith("k"), 1_000).when(bare.endswith("m"), 1_000_000).when(bare.endswith("b"), 1_000_000_000).otherwise(1)
    return (number * times.cast("decimal(10,0)")).cast("decimal(38,6)")


def unsupported_numbers(text: Column, source: Column) -> Column:
    """Number tokens of ``text`` that ``source`` has neither as they are nor as the same quantity, sorted."""
    allowed = number_tokens(source)
    values = F.transform(allowed, number_value)
    bare = F.transform(allowed, lambda t: F.regexp_replace(F.lower(t), r"^\$|[kmb]?%?$", "").try_cast("decimal(28,6)").cast("decimal(38,6)"))
    known = F.array_compact(F.concat(values, bare))
    return F.array_sort(F.filter(F.array_except(number_tokens(text), allowed), lambda t: number_value(t).isNull() | ~F.coalesce(F.array_contains(known, number_value(t)), F.lit(False))))


def number_keys(tokens: Column) -> Column:
    """What a text with these ``number_tokens`` supports: the tokens and, after an equals sign, their quantities, with K, M and B multiplied out and without. Keys of texts joined by line breaks are those of each."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"^\$|[kmb]?%?$", "").try_cast("decimal(28,6)").cast("decimal(38,6)")
    quantities = F.flatten(F.transform(tokens, lambda t: F.array(number_value(t), bare(t))))
    return F.array_distinct(F.concat(tokens, F.transform(F.array_compact(quantities), lambda q: F.concat(F.lit("="), q.cast("string")))))


def without_support(tokens: Column, keys: Column) -> Column:
    """Of ``number_tokens`` those that ``number_keys`` have neither as they are nor as the same quantity, sorted; as ``unsupported_numbers``, for sources that are read once for many texts."""
    same = lambda t: F.array_contains(keys, F.concat(F.lit("="), number_value(t).cast("string")))
    return F.array_sort(F.filter(tokens, lambda t: ~F.array_contains(keys, t) & ~F.coalesce(same(t), F.lit(False))))


# --- addresses -------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def _unescaped(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


def unescaped(text: Column) -> Column:
    """Character references undone: numeric ones, and named ones by their longest match, with or without semicolon. Only texts with an ampersand leave the JVM."""
    has = F.contains(text, F.lit("&"))
    return F.when(has, _unescaped(F.when(has, text))).otherwise(text)


def html_text(source: Column) -> Column:
    """Tags as spaces, character references undone, white space of every kind squeezed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(source, "<[^>]+>", " ")), ANY_SPACE, " "))


def _form_decoded(text: Column) -> Column:
    """A form's name or value as text: a plus is a space, and a percent sign that begins no byte stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encoded(text: Column) -> Column:
    """All but letters, digits and ``_.-~`` as percent-encoded bytes, a space as a plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, the query decoded and encoded again, without fragment and tracking parameters; null unless http or https with a host."""
    whole = F.regexp_replace(F.translate(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "\t\r\n", ""), "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(whole, "^[A-Za-z]+://([^/?]*)", 1))
    path = F.regexp_extract(whole, "^[A-Za-z]+://[^/?]*([^?]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")
    named = F.transform(pairs, lambda p: F.struct(_form_decoded(F.substring_index(p, "=", 1)).alias("k"), _form_decoded(value(p)).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).isin(L.TRACKING) & ~F.startswith(F.lower(p["k"]), F.lit(L.TRACKING_PREFIX)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    out = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), out)


# --- references ------------------------------------------------------------------


def span_ref(base: Column, start: Column, end: Column) -> Column:
    return F.concat(base, F.lit("#chars="), start, F.lit("-"), end)


def split_ref(ref: Column) -> Column:
    """struct(base, start, end); a reference without a well-formed span is a base alone."""
    pattern = r"^(.*)#chars=(\d+)-(\d+)$"
    fits = ref.rlike(pattern)
    return F.struct(
        F.when(fits, F.regexp_extract(ref, pattern, 1)).otherwise(ref).alias("base"),
        F.when(fits, F.regexp_extract(ref, pattern, 2)).try_cast("int").alias("start"),
        F.when(fits, F.regexp_extract(ref, pattern, 3)).try_cast("int").alias("end"),
    )


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("…"))).otherwise(text)


def terminated(text: Column) -> Column:
    """A sentence with a mark at its end."""
    return F.when(text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def bullet(action: Column, result: Column) -> Column:
    """One line of an action and its result, if there is one."""
    clean = F.regexp_replace(F.trim(action), r"[.]+$", "")
    return F.when(result.isNull(), terminated(F.trim(action))).otherwise(terminated(F.concat(clean, F.lit(" — "), F.trim(result))))


def digest(*columns: Column) -> Column:
    """SHA-256 of columns with a separator that no text has."""
    return F.sha2(F.concat_ws("\u001f", *columns), 256)


def short_id(prefix: str, text: Column) -> Column:
    """prefix- and the first 12 hex digits of the digest of the normal key."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(normal_key(text), 256), F.lit(12)))
