"""Text scalars with Unicode word and white-space semantics.

The JVM's ``\\w``, ``\\s`` and ``\\b`` are ASCII-only, so the classes are
spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from reelscope import fixed_values as fv
from reelscope.functions.numeric import clip, col, let
from reelscope.functions.terms import contains_any, sql_text, term_hits

SPACE = r"\s\x0b\p{Z}\x1c-\x1f\x{85}"
WORD = r"[\p{L}\p{N}_]+"
SPACE_CHARS = "".join(
    chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def text(value) -> Column:
    if isinstance(value, str):
        name = ".".join(f"`{part}`" for part in value.split("."))
        return F.expr(f"coalesce(cast({name} AS string), '')")
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value) -> Column:
    return F.btrim(text(value), F.lit(SPACE_CHARS))


def clean(value) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text(value), f"[{SPACE}]+", " "))


def words(value) -> Column:
    """White-space tokens; an empty array for blank text."""
    s = strip(value)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"[{SPACE}]+"))


def token_count(value) -> Column:
    """Number of white-space tokens without building them."""
    return F.regexp_count(text(value), F.lit(f"[^{SPACE}]+"))


def word_count(value) -> Column:
    return F.regexp_count(text(value), F.lit(WORD))


def count_chars(t: Column, char_class: str) -> Column:
    """Characters of a class, as the length lost by removing its runs (no array of matches)."""
    return F.length(t) - F.length(F.regexp_replace(t, f"[{char_class}]+", ""))


def count_text(t: Column, needle: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))


def uppercase_ratio(value) -> Column:
    counts = F.struct(
        count_chars(text(value), r"\p{L}").alias("letters"), count_chars(text(value), r"\p{Lu}").alias("upper")
    )
    return let(
        counts,
        lambda c: F.when(c["letters"] > 0, F.round(c["upper"] / c["letters"], 4)).otherwise(F.lit(0.0)),
    )


def char_counts(value) -> dict[str, Column]:
    t = text(value)
    return {
        "text_total_len": F.length(t),
        "exclamation_count": count_text(t, "!"),
        "question_count": count_text(t, "?"),
        "digit_count": count_chars(t, r"\p{Nd}"),
    }


def text_total(*parts) -> Column:
    """Parts joined by one space and trimmed (inference form)."""
    return strip(F.concat_ws(" ", *[text(p) for p in parts]))


def corpus_text(*parts) -> Column:
    """Parts joined by one space, untrimmed (training form)."""
    return F.concat_ws(" ", *[text(p) for p in parts])


def relevance_tokens(value, stopwords=fv.RELEVANCE_STOPWORDS) -> Column:
    """Set of lower-case tokens of three or more characters, without URLs and stop words."""
    return F.array_distinct(_tokens(value, r"a-záéíóúüñ0-9", stopwords, mentions=False))


def content_tokens(value, extra_stopwords=(), stopwords=fv.SENTIMENT_STOPWORDS) -> Column:
    """Bag of lower-case letter tokens without URLs, mentions, tags and stop words."""
    extra = tuple(str(w).lower().strip() for w in extra_stopwords if str(w).strip())
    return _tokens(value, r"a-záéíóúüñ", tuple(stopwords) + extra, mentions=True)


def _tokens(value, letters, stopwords, *, mentions) -> Column:
    t = F.lower(text(value))
    t = F.regexp_replace(t, f"https?://[^{SPACE}]+", " ")
    t = F.regexp_replace(t, f"www\\.[^{SPACE}]+", " ")
    if mentions:
        t = F.regexp_replace(t, r"[@#][\p{L}\p{N}_]+", " ")
    # Runs of three or more kept characters are exactly the tokens that survive the length rule.
    long_tokens = F.regexp_extract_all(t, F.lit(f"([{letters}]{{3,}})"), F.lit(1))
    stop = F.expr("array(" + ",".join(sql_text(w) for w in dict.fromkeys(stopwords) if len(w) >= 3) + ")")
    return F.filter(long_tokens, lambda w: ~F.array_contains(stop, w))


def sentiment_clean(value) -> Column:
    t = F.regexp_replace(F.lower(text(value)), r"[^\p{L}\p{N}_" + SPACE + "]", " ")
    return F.trim(F.regexp_replace(t, f"[{SPACE}]+", " "))


def sentences(value, delimiters: str = ".!?") -> Column:
    parts = F.split(text(value), f"[{delimiters}]+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(SPACE_CHARS))), lambda s: s != "")


def mean_sentence_length(value, delimiters: str = ".!?") -> Column:
    """Mean tokens per sentence, from two pattern counts instead of arrays of arrays."""
    t = text(value)
    n_words = F.regexp_count(t, F.lit(f"[^{SPACE}{delimiters}]+"))
    n_sentences = F.regexp_count(t, F.lit(f"[^{SPACE}{delimiters}][^{delimiters}]*"))
    return F.when(n_sentences > 0, n_words / n_sentences).otherwise(F.lit(0.0))


def first_words(value, n: int) -> Column:
    return F.array_join(F.slice(words(value), 1, n), " ")


def clip_text(value, n: int) -> Column:
    t = clean(value)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def extract_video_id(value) -> Column:
    """Bare id, short host, query parameter or /shorts|embed|live/ path; otherwise null."""
    v = strip(value)
    ok = "^[A-Za-z0-9_-]{11}$"
    host = F.lower(F.regexp_extract(v, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    path = _url_path(v)
    query = F.regexp_extract(v, r"^[^?#]*\?([^#]*)", 1)
    raw_v = F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)
    param = F.coalesce(F.try_url_decode(raw_v), raw_v)
    short = F.regexp_extract(path, r"^/*([^/]*)", 1)
    tail = F.regexp_extract(path, r"/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})", 1)
    valid = lambda c: F.when(c.rlike(ok), c)
    return (
        F.when(v.rlike(ok), v)
        .when(host.contains("youtu.be"), valid(short))
        .when(host.contains("youtube.com") & (param != ""), valid(param))
        .when(host.contains("youtube.com") & (tail != ""), tail)
    )


def _url_path(v: Column) -> Column:
    rest = F.regexp_replace(v, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")


def channel_hint(value) -> Column:
    """struct(type, value) for a channel URL, id, handle or free text."""
    v = strip(value)
    path = F.regexp_replace(_url_path(v), "^/+|/+$", "")
    first = F.regexp_extract(path, "^([^/]*)", 1)
    second = F.regexp_extract(path, "^[^/]*/([^/]*)", 1)
    has_second = path.contains("/")

    def hint(kind, val):
        return F.struct(F.lit(kind).alias("type"), val.alias("value"))

    return (
        F.when(v == "", hint("", F.lit("")))
        .when(v.startswith("UC") & (F.length(v) >= 20), hint("id", v))
        .when(v.startswith("@"), hint("handle", v))
        .when(path.startswith("@"), hint("handle", path))
        .when(has_second & (first == "channel"), hint("id", second))
        .when(has_second & (first == "c"), hint("c", second))
        .when(has_second & (first == "user"), hint("user", second))
        .otherwise(hint("query", v))
    )


def iso_duration_seconds(value) -> Column:
    """``PT#H#M#S`` to seconds; null unless the whole text matches."""
    v = text(value)
    pattern = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?$"

    def part(i):
        return F.coalesce(F.regexp_extract(v, pattern, i).try_cast("bigint"), F.lit(0))

    return F.when(v.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def ocr_normalize(value) -> Column:
    t = F.regexp_replace(text(value), r"\x0c", " ")
    return clean(F.regexp_replace(t, r"[|_~`^]{2,}", " "))


def ocr_line_quality(value) -> Column:
    """0 for noise lines, otherwise a bounded score from letter, digit and symbol shares."""
    return let(ocr_normalize(value), normal_line_quality)


def normal_line_quality(c: Column) -> Column:
    """Quality of a line that is normalised already."""
    n = F.greatest(F.length(c), F.lit(1))
    shares = F.struct(
        (count_chars(c, r"\p{L}\p{N}") / n).alias("alnum"),
        (count_chars(c, r"\p{L}") / n).alias("letters"),
        (count_chars(c, r"^\p{L}\p{N}" + SPACE + r".,:;!?¿¡%$#@+\-/()") / n).alias("odd"),
    )

    def score(x):
        sparse = (x["alnum"] < 0.35) & (x["letters"] < 0.25)
        return F.when(sparse, F.lit(0.0)).otherwise(clip(x["alnum"] + x["letters"] * 0.4 - x["odd"] * 1.4, 0.0, 1.0))

    noise = (F.length(c) < 3) | F.lower(c).rlike(r"(.)\1{4,}")
    return F.when(noise, F.lit(0.0)).otherwise(let(shares, score))


def stable_jitter(value, span: float = 0.16, empty: str | None = None) -> Column:
    """Deterministic factor in ``1 ± span`` from the first 32 bits of SHA-256; ``empty`` stands in for null and empty text, if given."""
    t = col(value).cast("string")
    if empty is not None:
        t = F.coalesce(F.nullif(t, F.lit("")), F.lit(empty))
    bits = F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("double")
    return F.lit(1.0) + (bits / F.lit(4294967295.0) - 0.5) * 2 * span


def strip_fences(value) -> Column:
    t = F.regexp_replace(strip(value), r"(?i)^```(?:markdown|json|text)?", "")
    t = F.regexp_replace(strip(t), r"```$", "")
    return strip(F.regexp_replace(strip(t), r"\n{3,}", "\n\n"))


def json_object_text(value) -> Column:
    """The JSON object inside generated text (fences and chatter tolerated); null when there is none."""
    t = strip_fences(value)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole_ok = t.startswith("{") & F.try_parse_json(t).isNotNull()
    other_json = F.try_parse_json(F.when(t != "", t)).isNotNull() & ~t.startswith("{")
    inner_ok = F.try_parse_json(F.when(inner != "", inner)).isNotNull()
    return F.when(whole_ok, t).when(~other_json & inner_ok, inner)


def extract_json(value, schema) -> Column:
    return F.from_json(json_object_text(value), schema)


CONTRACT_SCORES = ("claridad_mensaje", "fuerza_cta", "coherencia_semantica")
CONTRACT_LISTS = ("fortalezas", "debilidades", "ajustes_sugeridos")
CONTRACT_SCHEMA = StructType(
    [
        StructField(k, ArrayType(StringType()) if k in CONTRACT_LISTS else StringType())
        for k in fv.CONTRACT_KEYS
    ]
)


def coerce_contract(json_text, fallback) -> Column:
    """Parsed output forced into the eleven-key contract; ``fallback`` is a struct of the same keys."""
    raw = F.from_json(col(json_text), CONTRACT_SCHEMA)
    present = F.json_object_keys(col(json_text))
    fb = col(fallback)

    def value(k):
        return F.when(F.array_contains(present, k), raw[k]).otherwise(fb[k].cast(CONTRACT_SCHEMA[k].dataType))

    fields = []
    for k in fv.CONTRACT_KEYS:
        if k in CONTRACT_SCORES:
            number = F.bround(value(k).try_cast("double"))
            fields.append(F.coalesce(clip(number, 0.0, 100.0), fb[k].cast("double"), F.lit(50.0)).cast("int").alias(k))
        elif k in CONTRACT_LISTS:
            fields.append(F.coalesce(value(k), fb[k], F.array().cast("array<string>")).alias(k))
        else:
            fields.append(value(k).alias(k))
    return F.struct(*fields)


def generated_text_quality(value, *, min_words=fv.GENERATED_MIN_WORDS, min_domain=2, min_unique=0.72) -> Column:
    """struct(ok, reason): first failing rule wins."""
    t = F.lower(strip_fences(value))
    tokens = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    n = F.regexp_count(t, F.lit(WORD))
    domain = term_hits(t, fv.GENERATED_DOMAIN_TERMS)
    forbidden = contains_any(t, fv.GENERATED_FORBIDDEN)

    def distinct_share(w):
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 4),
            lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(4)]),
        )
        return F.when(F.size(w) >= 4, F.size(F.array_distinct(grams)) / (F.size(w) - 3)).otherwise(F.lit(1.0))

    unique = let(tokens, distinct_share)

    def out(ok, reason):
        return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))

    return (
        F.when(t == "", out(False, "vacia"))
        .when(n < min_words, out(False, "corta"))
        .when(forbidden == 1, out(False, "incoherente"))
        .when(domain < min_domain, out(False, "fuera_de_dominio"))
        .when(unique < min_unique, out(False, "repetitiva"))
        .otherwise(out(True, "ok"))
    )


def needs_stable_text(value) -> Column:
    """Second filter on generated recommendations: short, garbled, repetitive or contradictory."""
    t = F.lower(text(value))
    garbled = None
    for m in fv.GUARD_BAD_MARKERS:
        garbled = t.contains(m) if garbled is None else garbled | t.contains(m)
    contradictory = t.contains("no invertir") & t.contains("puede avanzar") & t.contains("sí invertir")
    repeated = F.regexp_count(t, F.lit("hallazgo")) >= 4
    return (token_count(t) < 70) | repeated | garbled | contradictory


def recommendation_guard(value, mode, stable_text) -> Column:
    """The text itself, or the rule text when a local generator produced something unusable."""
    local = F.lower(text(mode)).contains("local")
    replace = local & needs_stable_text(value)
    return F.struct(
        F.when(replace, col(stable_text)).otherwise(text(value)).alias("recomendacion"),
        F.when(replace, F.substring(text(value), 1, 1200)).alias("recomendacion_original"),
        replace.alias("estabilizada"),
    )


def _trim_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def age_label(hours) -> Column:
    """Hours with unit; two decimals below 100, one above, at most six significant digits."""
    h = F.greatest(F.coalesce(col(hours).cast("double"), F.lit(0.0)), F.lit(0.0))
    v = F.when(h < 100, F.round(h, 2)).otherwise(F.round(h, 1))
    mantissa = F.split(F.format_string("%.5e", v), "e")
    shown = (
        F.when(v < 100, _trim_zeros(F.format_string("%.2f", v)))
        .when(v < 99999.95, _trim_zeros(F.format_string("%.1f", v)))
        .when(v < 999999.5, F.format_string("%.0f", v))
        .otherwise(F.concat(_trim_zeros(mantissa[0]), F.lit("e"), mantissa[1]))
    )
    return F.concat(shown, F.when(F.abs(v - 1) < 0.05, F.lit(" hora")).otherwise(F.lit(" horas")))


def pct_label(value) -> Column:
    return F.coalesce(F.concat(F.format_number(col(value).try_cast("double"), "0.0"), F.lit("%")), F.lit("—"))


def number_label(value) -> Column:
    return F.coalesce(F.format_number(col(value).try_cast("double"), 0), F.lit("—"))


def fixed_label(value, digits: int = 2) -> Column:
    pattern = "0." + "0" * digits if digits else "0"
    return F.coalesce(F.format_number(col(value).try_cast("double"), pattern), F.lit("—"))
