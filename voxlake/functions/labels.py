"""Labels of speakers, statuses, phases and languages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake import constants as K


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def default_name(speaker: Column) -> Column:
    return F.concat(F.lit("Speaker "), (speaker + 1).cast("string"))


def default_voice(speaker: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in K.VOICES]), (F.pmod(speaker, F.lit(len(K.VOICES))) + 1).cast("int"))


def status_label(status: Column) -> Column:
    known = F.try_element_at(_map(K.STATUS_LABELS), status)
    return F.coalesce(known, F.nullif(F.translate(status, "_", " "), F.lit("")), F.lit("Unknown"))


def status_class(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(K.STATUS_CLASSES), status), F.lit("default"))


def normalize_phase(phase: Column) -> Column:
    """A phase a project may be restarted from; anything else is 'init'."""
    return F.when(phase.isin(*K.RESTART_PHASES), phase).otherwise("init")


def language_name(code: Column, short: bool = False) -> Column:
    """Display name; an unknown code is shown as it is."""
    rows = K.LANGUAGES[: K.SHORT_LANGUAGE_LIST] if short else K.LANGUAGES
    return F.coalesce(F.try_element_at(_map({c: name for c, name, _ in rows}), code), code)


def language_code(text: Column) -> Column:
    """The code of a language given by code or alias, in lower case; unknown text stays."""
    codes = {spelling: code for code, _, aliases in K.LANGUAGES for spelling in (code, *aliases)}
    return F.coalesce(F.try_element_at(_map(codes), F.lower(text)), F.lower(text))


def needs_translation(source: Column, target: Column) -> Column:
    return language_code(source) != language_code(target)
