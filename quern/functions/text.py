"""Text functions as Spark columns: whitespace, tokens, sentences, headings, noise, rune density, snippets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that must equal those of the service whose results are matched.
SPACE = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"[\p{L}\p{N}_-]+"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
RUNE_WORDS = ["руна", "руны", "рун", "rune", "runes", "futhark", "орхон", "старотюрк", "runic"]
RUNIC = r"[\x{16A0}-\x{16FF}\x{10C00}-\x{10C4F}]"
NUMBERED = r"^(\d+(?:\.\d+){0,3})[.)] (.+)$"
ROMAN = r"^([IVXLCM]{1,8})[.)] (.+)$"
DOTTED_LEADER = r"\.{5,}"
PAGE_COUNTER = r"(?:^| )[-–—]? ?\d+ ?/ ?\d+$"
CONTINUED = r"[,;:–—-]$"
SHORT_CODE = r"(?i)^[A-Z]?\d[\p{L}\p{N}_./-]*$"
CHART_ROW = r"^[0-9A-FXx]{3,6}; "
TECHNICAL_QUERY = ["code", "codepoint", "unicode", "ucs", "smp", "letter", "character", "chart", "table", "symbol", "block", "encoding", "properties", "код", "юникод", "символ", "букв", "таблиц"]
CODE_CHART = r"(?iuU)\b1xx[0-9a-f]{1,2}\b|KHAZARIAN ROVAS LETTER"
ADMIN_FORM = ["appendix", "proposal summary form", "administrative", "requester", "reference", "choose one of the following", "submitted before", "iso/iec 10646", "приложение", "административ"]
LOW_VALUE = ["contents", "bibliography", "acknowledgement", "references", "оглавление", "библиограф", "благодарност"]
FENCE = r"^```.*$"
MARKER_LINE = r"(?i)^\[(?:OCR|IMAGE\b)"
LIST_START = r"(?iu)^(?:\d+(?:\.\d+)*[.)]|[a-zа-я][.)]|[-*]) "
TOPIC_START = (
    r"(?iuU)^(?:fig(?:ure)?\.?|table|scheme|plate|appendix|summary|contents|bibliography|рис\.?|табл\.?|схема|приложение|выводы|содержание|литература|"
    r"written in|ipa phonetic transcription|translation from|перевод|транскрипция|надпись|памятник)\b"
)
SENTENCE_END = r"""[.!?…:;]['")\]]*$"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value that an expression uses more than once (inside a lambda nothing else keeps Spark from computing it each time)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(text: Column, pattern: str) -> Column:
    """Whether a pattern is found in the text."""
    return text.rlike(pattern)


def any_word(words: list[str]) -> str:
    """A pattern for whole words, any case, in Cyrillic too."""
    return r"(?iuU)\b(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")\b"


def collapse(text: Column) -> Column:
    """White space (Unicode) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text: split where white space follows a stop."""
    return F.filter(F.split(collapse(text), r"(?<=[.!?]) "), lambda s: s != "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def upper_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}]+", ""), r"(?U)[^\p{Upper}]+", ""))


def words(text: Column) -> Column:
    """Words of a collapsed text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def rune_density(text: Column) -> Column:
    """Runic characters by characters that are not white space; 0 where there are none."""
    density = lambda solid: F.when(F.length(solid) > 0, (F.length(solid) - F.length(F.regexp_replace(solid, RUNIC, ""))) / F.length(solid)).otherwise(F.lit(0.0))
    return let(F.regexp_replace(text, SPACE, ""), density)


def is_rune_query(text: Column) -> Column:
    return F.coalesce(rx(text, any_word(RUNE_WORDS)), F.lit(False))


def is_page_noise(line: Column) -> Column:
    """Blank lines and page counters."""
    return let(collapse(line), lambda s: (s == "") | (rx(s, PAGE_COUNTER) & (F.size(tokens(s)) >= 4)) | rx(s, r"^\d+ ?/ ?\d+$"))


def heading(line: Column) -> Column:
    """struct(level 1..3, title) of a heading line, else null."""
    return let(collapse(line), _heading)


def _heading(s: Column) -> Column:
    ws = words(s)
    n_words = F.size(ws)
    never = (F.length(s) < 3) | ((n_words <= 2) & rx(s, SHORT_CODE)) | rx(s, CHART_ROW) | rx(s, DOTTED_LEADER) | rx(s, CONTINUED)
    stop = lambda x: rx(x, r"[.!?]$")
    title = F.regexp_extract(s, NUMBERED, 2)
    depth = F.least(F.size(F.split(F.regexp_extract(s, NUMBERED, 1), r"\.")), F.lit(3))
    numbered_ok = (F.length(title) <= 90) & ~stop(title) & (letters(title) >= 3)
    roman_prefix, roman_title = F.regexp_extract(s, ROMAN, 1), F.trim(F.regexp_extract(s, ROMAN, 2))
    roman_ok = rx(s, ROMAN) & (n_words <= 8) & (F.length(s) <= 80) & ((F.length(roman_prefix) > 1) | roman_prefix.isin("I", "V", "X")) & (letters(roman_title) >= 3)
    plain = (n_words <= 10) & (F.length(s) <= 84) & ~stop(s) & (letters(s) >= 3)
    titled = F.filter(ws, lambda w: rx(w, r"\p{L}"))
    capital = F.filter(titled, lambda w: rx(w, r"(?U)^\p{Upper}"))
    shouting = upper_letters(s) > 0.72 * letters(s)
    title_case = (F.size(capital) > 0.8 * F.size(titled)) & (n_words <= 7) & (F.length(s) <= 68)
    found = lambda level, text: F.struct(level.cast("int").alias("level"), text.alias("title"))
    none = F.lit(None).cast("struct<level:int,title:string>")
    return (
        F.when(F.coalesce(never, F.lit(True)), none)
        .when(rx(s, NUMBERED), F.when(numbered_ok, found(F.when((depth == 1) & (F.length(title) > 48), F.lit(2)).otherwise(depth), F.trim(title))).otherwise(none))
        .when(roman_ok, found(F.lit(1), roman_title))
        .when(plain & (shouting | title_case), found(F.lit(2), s))
        .otherwise(none)
    )


def starts_block(line: Column) -> Column:
    return rx(line, MARKER_LINE) | rx(line, TOPIC_START) | rx(line, LIST_START)


def ends_sentence(line: Column) -> Column:
    return rx(line, SENTENCE_END)


def snippet(text: Column, n: int) -> Column:
    s = collapse(text)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def safe_name(text: Column) -> Column:
    name = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"))
    name = F.regexp_replace(name, r"^_+|_+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("sample")).otherwise(name)


@F.pandas_udf(StringType())
def _ascii(text: pd.Series) -> pd.Series:
    """NFKD without what is not ASCII (no Spark builtin decomposes)."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def _token(text: pd.Series) -> pd.Series:
    """Eight hex digits of a blake2b hash (no Spark builtin has it)."""
    return text.map(lambda s: None if s is None else hashlib.blake2b(s.encode(), digest_size=4).hexdigest())


def slug(text: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(_ascii(text), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("book")).otherwise(s)


def file_name(path: Column) -> Column:
    """A safe .pdf name from an uploaded path; a hash where nothing is left."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    name = F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    name = F.when(name == "", F.concat(F.lit("book_"), _token(base), F.lit(".pdf"))).otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def ocr_clean(text: Column) -> Column:
    """OCR answers without code-fence lines."""
    return F.trim(F.array_join(F.filter(lines(text), lambda s: ~rx(F.trim(s), FENCE)), "\n"))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
