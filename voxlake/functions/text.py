"""Text columns: cleaning, classing, packing into sentences, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake import constants as K

# Patterns.  Java's \w and \s are ASCII, the classes below cover all scripts.
WORD = r"[\p{L}\p{N}_]"
SPACE_CHARS = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
# Whitespace that is not already one single space.
SPACE_TO_FIX = rf"[{SPACE_CHARS}&&[^ ]][{SPACE_CHARS}]*| [{SPACE_CHARS}]+"
NOT_KEPT = rf"[^\p{{L}}\p{{N}}_{SPACE_CHARS},.?!']"
NOT_WORD_OR_SPACE = rf"[^\p{{L}}\p{{N}}_{SPACE_CHARS}]"
STRIPPED = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(STRIPPED))


def is_blank(text: Column) -> Column:
    """NULL, empty, or nothing but whitespace."""
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_text(text: Column) -> Column:
    """Readable punctuation, single spaces, no symbols, a closing mark; NULL becomes ''."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, r"\.{2,}|-{2,}", ",")
    out = F.regexp_replace(out, SPACE_TO_FIX, " ")
    out = F.trim(F.regexp_replace(out, f"{NOT_KEPT}+", ""))
    # The end of a text whose last character closes nothing; a CASE would clean the text twice.
    return F.regexp_replace(out, r"(?<=[^.!?,])\z", ".")


def text_class(text: Column) -> Column:
    """'empty', 'symbols' (no letter or digit in any script), 'non_ascii' (none in ASCII) or 'words'."""
    return (
        F.when(is_blank(text), "empty")
        .when(strip(F.regexp_replace(text, NOT_WORD_OR_SPACE, "")) == "", "symbols")
        .when(~text.rlike("[a-zA-Z0-9]"), "non_ascii")
        .otherwise("words")
    )


PAGE = 64


def pack_sentences(text: Column, limit: int = 250) -> Column:
    """Array of chunks: the whole text when short, else sentences packed up to ``limit`` characters.

    One fold over the sentences. Ended chunks are gathered in pages, so that a very long text copies a page for
    each of its chunks and not all chunks before it."""
    whole = strip(text)
    sentences = F.filter(
        F.transform(F.split(F.translate(whole, "!?", ".."), r"\."), strip), lambda s: F.length(s) > 0
    )
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("pages"), none.alias("page"), F.lit("").alias("open"))

    def close(state: Column) -> tuple[Column, Column]:
        """The pages and the page after the open chunk's end. Only a page of at most PAGE chunks is copied for it."""
        full = F.size(state["page"]) >= PAGE
        ended = F.array(F.rtrim(state["open"]))
        return F.when(full, F.concat(state["pages"], F.array(state["page"]))).otherwise(state["pages"]), F.when(full, ended).otherwise(F.concat(state["page"], ended))

    def add(state: Column, sentence: Column) -> Column:
        goes_on = (F.length(state["open"]) + F.length(sentence) + 1 <= limit) | (state["open"] == "")
        pages, page = close(state)
        return F.struct(
            F.when(goes_on, state["pages"]).otherwise(pages).alias("pages"),
            F.when(goes_on, state["page"]).otherwise(page).alias("page"),
            F.concat(F.when(goes_on, state["open"]).otherwise(""), sentence, F.lit(". ")).alias("open"),
        )

    def finish(state: Column) -> Column:
        pages, page = close(state)
        return F.flatten(F.concat(F.when(state["open"] == "", state["pages"]).otherwise(pages), F.array(F.when(state["open"] == "", state["page"]).otherwise(page))))

    packed = F.aggregate(sentences, start, add, finish)
    return (
        F.when(is_blank(text), F.array().cast("array<string>"))
        .when(F.length(whole) <= limit, F.array(whole))
        .otherwise(packed)
    )


def _fill(template: str, **values: Column) -> Column:
    """A template's fixed text with columns in place of its {names}."""
    pieces: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(values[name])
    return F.concat(*pieces)


def translation_prompt(text: Column, language: Column, short: bool = False) -> Column:
    template = K.SHORT_TRANSLATION_PROMPT if short else K.TRANSLATION_PROMPT
    return _fill(template, text=text, lang=language)


def analysis_prompt(text: Column, mode: Column) -> Column:
    """NULL for a mode that is not known; see ``analysis_error``."""
    out = F.when(F.lit(False), F.lit(""))
    for name, system in K.ANALYSIS_SYSTEM.items():
        out = out.when(mode == name, F.concat(F.lit(system + K.ANALYSIS_BODY), text))
    return out


def analysis_error(mode: Column) -> Column:
    known = F.coalesce(mode.isin(*K.ANALYSIS_SYSTEM), F.lit(False))
    return F.when(~known, F.lit(K.UNKNOWN_MODE))


def truncate(text: Column, limit: int) -> Column:
    return (
        F.when(text.isNull(), "")
        .when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("...")))
        .otherwise(text)
    )


def is_cpu_error(message: Column, long_list: bool = False) -> Column:
    words = K.CPU_ERROR_WORDS_LONG if long_list else K.CPU_ERROR_WORDS
    return F.lower(message).rlike("|".join(words))


# Wording and length of stored error texts.
ERROR_TEXTS = {
    "transcription": ("[Transcription error: ", 50, "]"),
    "synthesis": ("TTS failed, using silence: ", 100, ""),
    "critical": ("Critical failure: ", 200, ""),
}


def error_text(message: Column, kind: str) -> Column:
    before, length, after = ERROR_TEXTS[kind]
    return F.concat(F.lit(before), F.substring(message, 1, length), F.lit(after))
