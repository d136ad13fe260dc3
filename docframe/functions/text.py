"""Column functions on recognised text: numbers, scripts, flags, Markdown and HTML.

All are built-in expressions, so they run inside the scan's projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches define the results.
NUMBER = r"[-+]?\d+(?:[\s,.]\d+)?"
#: The axis letters stand alone; written without a word boundary, as engines differ on it.
AXIS = r"(^|[^\p{L}\p{N}_])[XYNExyne]($|[^\p{L}\p{N}_])"
AXIS_STEMS = r"(?iu)широт|долгот|север|восток"
TABLE_SIGNAL = r"(\d+[,.]\d+|\d+\s+\d+|[|;\t])"
CYRILLIC = "[А-Яа-яЁё]"
LATIN = "[A-Za-z]"
SUSPICIOUS = "[�□■●◆◇◊¤¬]"
NUMERIC_ONLY = r"^[\s\d.,%+\-–—/()№]+$"
NUMERIC_MARKS = ".,;:+-–—()[]{}\\/|=_%#№"
DIGIT_RUN = r"\d[\d .\-/]{2,}\d|\d{4,}"
DATE_LIKE = r"\d{1,4}(?:[./-]\d{1,2}){1,2}"
NUMERIC_TOKEN = r"(?U)(?<![\w])(?:" + DATE_LIKE + r"|\d{1,3}(?:[  ]\d{3})+(?:[.,]\d+)?|\d+[.,]\d+|\d+)(?![\w])"
WORD_TOKEN = "(?iu)[a-zа-яё]{2,}"
MOJIBAKE = ("Рџ", "Рё", "Рµ", "Р°", "РЅ", "С‚", "СЂ", "СЏ")
HOMOGLYPHS = ("ABEKMHOPCTXY", "АВЕКМНОРСТХУ")
ID_KEYWORDS = r"(?iu)(контракт|договор|закупк|идентификационн|икз|инн|кпп|бик|счет|сч[её]т|р/с|л/с|к/с|казначейск|протокол|акт|сумм|цена|ндс|руб|коп|номер|№)"
KIND_STEMS = (
    ("purchase_id", ("идентификацион", "икз")),
    ("contract_number", ("контракт", "договор")),
    ("tax_id", ("инн", "кпп")),
    ("bank_details", ("бик", "счет", "счёт", "р/с", "л/с", "к/с")),
    ("document_number", ("протокол", "акт")),
    ("money", ("цена", "сумм", "руб", "коп")),
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded as C and SQL engines do it: scaled, rounded to a whole number and scaled back.  F.round goes by the shortest
    decimal instead, so that it has 0.48224999999999996, whose ten thousandfold is 4822.5, as 0.4822, not as 0.4823."""
    return F.round(_col(x) * 10.0**places) / 10.0**places


def squeeze(x: Column | str) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def is_coordinate_like(x: Column | str) -> Column:
    """Two numbers or more, and an axis letter or a compass word."""
    x = _col(x)
    return (F.regexp_count(x, F.lit(NUMBER)) >= 2) & (x.rlike(AXIS) | x.rlike(AXIS_STEMS))


def is_table_like(x: Column | str) -> Column:
    x = _col(x)
    return (F.regexp_count(x, F.lit(NUMBER)) >= 3) | x.rlike(TABLE_SIGNAL)


def is_wide_line(x: Column | str, width: int = 180) -> Column:
    return ~is_coordinate_like(x) & is_table_like(x) & (F.length(_col(x)) > width)


def numbers(x: Column | str) -> Column:
    return F.regexp_extract_all(_col(x), F.lit(NUMBER), F.lit(0))


def count_of(x: Column | str, mark: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    x = _col(x)
    return ((F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def ratio(x: Column | str, pattern: str) -> Column:
    """Matches of a one-character pattern over all characters (0 for an empty text)."""
    x = _col(x)
    return F.regexp_count(x, F.lit(pattern)) / F.greatest(F.lit(1), F.length(x))


def cyrillic_ratio(x: Column | str) -> Column:
    """Cyrillic letters over Latin and Cyrillic ones."""
    x = _col(x)
    letters = F.regexp_count(x, F.lit("[A-Za-zА-Яа-яЁё]"))
    return F.when(letters > 0, F.regexp_count(x, F.lit(CYRILLIC)) / letters).otherwise(0.0)


def numeric_signal_ratio(x: Column | str) -> Column:
    """Digits and number punctuation over all characters that aren't white space."""
    dense = F.regexp_replace(_col(x), r"(?U)\s", "")
    other = F.length(F.translate(F.regexp_replace(dense, r"\p{Nd}", ""), NUMERIC_MARKS, ""))
    return F.when(F.length(dense) > 0, (F.length(dense) - other) / F.length(dense)).otherwise(0.0)


def repeated_punctuation(x: Column | str) -> Column:
    """Runs of three or more of the same mark."""
    return F.regexp_count(_col(x), F.lit(r"([.,;:!?\-_=*])\1{2,}"))


def digit_count(x: Column | str) -> Column:
    return F.regexp_count(_col(x), F.lit(r"\d"))


def digit_sequences(x: Column | str) -> Column:
    """Long digit runs, spaced or dashed ones included, as digits only; those of four digits and more, first occurrences."""
    found = F.transform(F.regexp_extract_all(_col(x), F.lit(DIGIT_RUN), F.lit(0)), lambda v: F.regexp_replace(v, r"\D", ""))
    return F.array_distinct(F.filter(found, lambda v: F.length(v) >= 4))


def comparison_status(raw: Column, located: Column, verified: Column) -> Column:
    """How digit sequences of a locator and of a verifier agree; identifiers of 12 digits and more take precedence."""
    long = lambda a: F.filter(a, lambda v: F.length(v) >= 12)
    a, b = long(located), long(verified)
    some = lambda v: F.size(v) > 0
    return (
        F.when(raw.contains("?"), "uncertain")
        .when(~some(located) & ~some(verified), "no_digits")
        .when(some(a), F.when(F.arrays_overlap(a, b), "match").when(some(b), "mismatch").otherwise("locator_only"))
        .when(some(b), "verifier_only")
        .when(F.arrays_overlap(located, verified), "match")
        .when(some(located) & some(verified), "mismatch")
        .when(some(located), "locator_only")
        .otherwise("verifier_only")
    )


def line_kind(x: Column | str) -> Column:
    """What sort of number a line holds; the first kind with a stem in the line."""
    low = F.lower(_col(x))
    out = None
    for kind, stems in KIND_STEMS:
        hit = None
        for stem in stems:
            hit = low.contains(stem) if hit is None else hit | low.contains(stem)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("long_number")


def visible(x: Column | str) -> Column:
    """HTML text whose entities are resolved (udf.unescape) without its tags."""
    return F.regexp_replace(_col(x), "<[^>]+>", " ")


def numeric_tokens(x: Column | str) -> Column:
    """Exact-value tokens in canonical form: dates as digits joined by dashes, else without spaces and with a decimal comma."""

    def canonical(v: Column) -> Column:
        plain = F.trim(F.replace(v, F.lit(" "), F.lit(" ")))
        date = F.array_join(F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0)), "-")
        return F.when(plain.rlike("^(?:" + DATE_LIKE + ")$"), date).otherwise(F.translate(F.replace(plain, F.lit(" "), F.lit("")), ".", ","))

    return F.transform(F.regexp_extract_all(_col(x), F.lit(NUMERIC_TOKEN), F.lit(0)), canonical)


def word_tokens(x: Column | str) -> Column:
    """Distinct lower-case words of two Latin or Cyrillic letters and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD_TOKEN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def casefold(x: Column | str) -> Column:
    """Lower case with ß spelt out: the folding that German needs."""
    return F.replace(F.lower(_col(x)), F.lit("ß"), F.lit("ss"))


def semantic_normal(x: Column | str) -> Column:
    """Folded text of digits, Latin and Cyrillic letters, words broken by a hyphen joined."""
    x = F.translate(casefold(x), "ё", "е")
    x = F.regexp_replace(x, r"(?U)(?<=\w)[\-–—]\s*(?=\w)", "")
    return F.trim(F.regexp_replace(x, "[^0-9a-zа-я]+", " "))


def anchor_token(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(casefold(x), "ё", "е"), "[^0-9a-zа-я]+", "")


def canonical_numbers(x: Column | str) -> Column:
    """Digit runs in order, their separators taken out."""
    return F.transform(F.regexp_extract_all(_col(x), F.lit(r"\d[\d\s.,]*"), F.lit(0)), lambda v: F.regexp_replace(v, r"[\s.,]", ""))


def near_equal_numbers(a: Column, b: Column) -> Column:
    """Lists of one length whose items are equal, or longer by the 1 that a table line looks like."""
    fits = F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (y == F.concat(x, F.lit("1")))), lambda v: v)
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & fits


def quality_flags(x: Column | str) -> Column:
    """Signs of a bad recognition, in a fixed order."""
    x = _col(x)
    broken = sum((count_of(x, m) for m in MOJIBAKE), F.lit(0))
    mixed = x.rlike(r"(?iuU)\b(?=[\w-]*[а-яё])(?=[\w-]*[a-z])[\w-]+\b")
    flags = F.array(
        F.when(x.contains("�"), "replacement_character"), F.when(broken >= 3, "probable_mojibake"), F.when(mixed, "mixed_latin_cyrillic"), F.when((F.length(x) > 0) & (F.length(x) < 20), "suspiciously_short")
    )
    return F.filter(flags, lambda f: f.isNotNull())


def physical_cell(x: Column | str) -> Column:
    """Text of a table cell read from the image: broken words joined, ruling marks dropped, short capital tokens in Cyrillic."""
    x = F.regexp_replace(_col(x), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    x = F.regexp_replace(x, r"\s*\n\s*", " ")
    x = squeeze(F.regexp_replace(x, r"(?:^|\s)[|_]+(?=\s|$)", " "))

    def token(t: Column) -> Column:
        letters = F.regexp_replace(t, "[^A-Za-zА-Яа-яЁё]", "")
        return F.when((F.length(letters) > 0) & (F.length(letters) <= 12) & (F.upper(letters) == letters), F.translate(t, *HOMOGLYPHS)).otherwise(t)

    return F.array_join(F.transform(F.split(x, " "), token), " ")


def clean_markdown_cell(x: Column | str) -> Column:
    """A cell without bold, italic and code marks."""
    x = F.regexp_replace(_col(x), r"\*\*(.*?)\*\*", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\*(.*?)\*", "$1"), r"`(.*?)`", "$1"))


def escape_cell_breaks(x: Column | str) -> Column:
    """For exported tables: line ends become <br>."""
    x = F.replace(_col(x), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(x, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


def escape_cell_plain(x: Column | str) -> Column:
    """For extracted tables: line ends become spaces."""
    x = F.replace(F.replace(_col(x), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.replace(F.trim(x), F.lit("|"), F.lit("\\|"))


def normalize_markdown(x: Column | str) -> Column:
    x = F.replace(F.replace(_col(x), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_text(x: Column | str) -> Column:
    """Tags and white space as single spaces."""
    return squeeze(F.regexp_replace(_col(x), "<[^>]+>", " "))


def escape_html(x: Column | str) -> Column:
    x = _col(x)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    return x


def number_text(x: Column | str, digits: int = 4) -> Column:
    """A number for reports: n/a, whole from 100 on, else up to `digits` decimals without closing zeros."""
    x = _col(x)
    short = F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"\.?0+$", "")
    return F.when(x.isNull(), "n/a").when(x == 0, "0").when(F.abs(x) >= 100, F.bround(x.cast("double")).cast("long").cast("string")).otherwise(F.when(F.length(short) > 0, short).otherwise("0"))


def truthy(x: Column | str) -> Column:
    return F.lower(F.trim(_col(x).cast("string"))).isin("1", "true", "yes", "on", "enabled")


def safe_float(x: Column | str, default: float = -1.0) -> Column:
    """A number, or the default for null, text and NaN."""
    return F.coalesce(F.nanvl(F.trim(_col(x).cast("string")).try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def cost_usd(ticks: Column | str) -> Column:
    t = _col(ticks).cast("string").try_cast("double")
    return F.when(t > 0, t / 1e10)


def prefix_conditions(primary: Column, other: Column) -> Column:
    """The text decision as far as it needs no similarity: (selected, reason), or null reason where that is to decide."""
    p, o = squeeze(primary), squeeze(other)
    numeric = r"^[\d\s.,:/%+()№-]+$"
    share = F.length(o) / F.greatest(F.lit(1), F.length(p))
    lost = F.regexp_count(o, F.lit(CYRILLIC)) < F.greatest(F.lit(1), F.floor(F.regexp_count(p, F.lit(CYRILLIC)) * 0.25))
    both = p.rlike(NUMERIC_ONLY) & o.rlike(NUMERIC_ONLY)
    return (
        F.when(F.length(o) == 0, "candidate_empty")
        .when(F.length(p) == 0, "primary_empty")
        .when(casefold(p) == casefold(o), "equivalent")
        .when(both & (canonical_numbers(p) != canonical_numbers(o)), "numeric_disagreement")
        .when(both, "numeric_agreement")
        .when((share < 0.5) | (share > 2.5), "implausible_length")
        .when((F.length(p) > 40) & (share < 0.72), "incomplete_candidate")
        .when((F.regexp_count(p, F.lit(CYRILLIC)) > 0) & lost, "cyrillic_loss")
    )
