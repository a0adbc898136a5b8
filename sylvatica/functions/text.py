"""Column factories for names, labels and lists.  Every function takes and returns Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a text is stripped of: all of Unicode's white space and the ASCII separators.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The controlled organ prompts, in order.
ORGAN_PROMPTS = ("leaf", "flower", "fruit", "stem", "bark", "bud", "branch", "whole plant")
#: Category names that stand for another.
CATEGORY_ALIASES = {"whole_plant": "plant", "branch": "stem"}
AMBIGUOUS = "ambiguous organ"


def strip(value: Column) -> Column:
    """Without white space at either end; SQL's ``trim`` removes blanks only."""
    return F.btrim(value, F.lit(BLANKS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often the lambdas of ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(value: Column) -> Column:
    stripped = strip(value)
    return F.when(stripped != "", stripped)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, stripped; white space alone counts as filled."""
    return F.coalesce(strip(F.coalesce(*[F.when(v != "", v) for v in values])), F.lit(""))


def normal_label(value: Column) -> Column:
    """Lower case, underscores as blanks, runs of white space as one blank."""
    spaced = F.regexp_replace(F.replace(F.lower(value), F.lit("_"), F.lit(" ")), f"[{SPACE}]+", " ")
    return F.trim(spaced)


def organ_label(label: Column, prompts: Sequence[str] = ORGAN_PROMPTS) -> Column:
    """The one controlled prompt that the label contains; a label with none or several is ambiguous."""
    normal = [re.sub(r"\s+", " ", p.lower().replace("_", " ")).strip() for p in prompts]

    def told(text: Column) -> Column:
        hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(n)), F.lit(p)) for p, n in zip(prompts, normal, strict=True)]))
        return once(hits, lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))).otherwise(F.lit(AMBIGUOUS)))

    return F.when(label.isNotNull(), once(normal_label(label), told))


def category_id(label: Column) -> Column:
    name = F.replace(strip(F.lower(label)), F.lit(" "), F.lit("_"))
    chosen = name
    for alias, target in CATEGORY_ALIASES.items():
        chosen = F.when(name == alias, F.lit(target)).otherwise(chosen)
    return F.concat(F.lit("category:"), chosen)


def gallery_category(detector_label: Column, prompt: Column, stored: Column, legacy: bool = False) -> Column:
    """The category that an annotation is shown under, told again from its raw label where it has one.

    ``legacy`` keeps the prompt's own spelling (``category:whole plant``), under which no category equals
    ``category:ambiguous_organ``; otherwise names are spelt as category ids are.
    """
    raw = F.coalesce(F.when(detector_label != "", detector_label), F.when(prompt != "", prompt))
    label = organ_label(raw)
    told = F.concat(F.lit("category:"), label) if legacy else category_id(label)
    return F.coalesce(told, stored)


def slug(value: Column, limit: int = 120) -> Column:
    safe = F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    cut = F.substring(safe, 1, limit)
    return F.when(cut == "", "none").otherwise(cut)


def split_list(value: Column) -> Column:
    """The parts between commas, stripped, without blank ones."""
    return F.filter(F.transform(F.split(value, ",", -1), strip), lambda x: x != "")


def file_name(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def joined_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def composite_key(left: Column, right: Column) -> Column:
    return F.concat_ws(":", left, right)


def whole_or_text(value: Column) -> tuple[Column, Column]:
    """(the number that a text spells or null, the text if it spells none)."""
    number = F.try_to_number(strip(value), F.lit("S999999999")).cast("long")
    number = F.coalesce(number, strip(value).try_cast("long"))
    return number, F.when(number.isNull(), value)


def trial_id(started: Column, model: Column, limit: Column, features: Column) -> Column:
    """stepwise-<time>-<model>-<n or all>-<features>; the time is given, so that reruns agree."""
    size = F.when(F.coalesce(limit, F.lit("")) == "", F.lit("all")).otherwise(F.concat(F.lit("n"), limit))
    wanted = slug(F.array_join(split_list(features), "-"))
    return F.concat_ws("-", F.lit("stepwise"), F.date_format(started, "yyyyMMdd-HHmmss"), slug(model), size, wanted)


def setting(line: Column) -> Column:
    """struct(key, value) of a line of a settings file; null where the line sets nothing."""
    text = strip(line)
    text = F.when(text.startswith("export "), F.regexp_replace(F.substr(text, F.lit(8)), f"^[{SPACE}]+", "")).otherwise(text)
    at = F.instr(text, "=")
    key, value = strip(F.substr(text, F.lit(1), at - 1)), strip(F.substr(text, at + 1))
    ends = F.substr(value, F.lit(1), F.lit(1))
    quoted = (F.length(value) >= 2) & ends.isin("'", '"') & (ends == F.right(value, F.lit(1)))
    bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    sets = (text != "") & ~text.startswith("#") & (at > 0) & (key != "")
    return F.when(sets, F.struct(key.alias("key"), bare.alias("value")))
