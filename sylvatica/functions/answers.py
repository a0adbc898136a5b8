"""Prompts for model calls, readers of their answers, and the scoring of a step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvatica.functions.text import once, strip

INCONCLUSIVE = "INCONCLUSIVE"
CANNOT = "Cannot determine from this image"

#: Names of features as prompts spell them.
FEATURE_NAMES = {
    "key_flower_type": "flower type",
    "key_plant_type": "plant type",
    "key_leaf_type": "leaf type",
    "key_subgroup_1": "subsidiary feature (subgroup 1)",
    "key_subgroup_2": "subsidiary feature (subgroup 2)",
    "key_subgroup_3": "subsidiary feature (subgroup 3)",
}
PRIMARY_FEATURES = ("key_flower_type", "key_plant_type", "key_leaf_type")

#: The wording of the prompts, {} for what varies.
EXISTENCE = (
    "Your task is to identify if the visual feature '{}' is discernible in the following image. "
    "Answer only: YES, NO, or INCONCLUSIVE. Answer YES if and only if the feature is clearly discernible in the image.{}"
)
NO_LEAVES = (
    " Note: the absence of visible leaves is itself a discernible leaf-type feature"
    " — if the stem has no apparent leaves, answer YES."
)
AGREEMENT = (
    "A botanical expert has classified the '{}' of the plant in this image as '{}'{}.\n"
    "Is this classification consistent with what you can observe in the image?\n"
    "Reply with exactly one word: YES, NO, or INCONCLUSIVE."
)
CHOICE = (
    "Which of the following options best describes the '{}' of the plant in this image?\n"
    "If the feature is not clearly visible, choose 'Cannot determine from this image'.\n\nOptions:"
)
CHOICE_END = '\nRespond with ONLY the exact option text (e.g., "{}") or "Cannot determine from this image".'


def filled(template: str, *values: Column) -> Column:
    """``template`` with a Column in place of each {}."""
    parts = template.split("{}")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        pieces += [value, F.lit(rest)]
    return F.concat(*pieces)


def part(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def feature_name(feature: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in FEATURE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, feature), feature)


def described(description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" — "), description)).otherwise("")


def existence_prompt(feature: Column, image: Column, truth: Column) -> Column:
    leafless = (feature == "key_leaf_type") & F.contains(F.lower(truth), F.lit("no apparent"))
    note = F.when(F.coalesce(leafless, F.lit(False)), F.lit(NO_LEAVES)).otherwise("")
    return F.array(part("image", image), part("text", filled(EXISTENCE, feature_name(feature), note)))


def agreement_prompt(feature: Column, truth: Column, description: Column, image: Column) -> Column:
    return F.array(part("image", image), part("text", filled(AGREEMENT, feature_name(feature), truth, described(description))))


def choice_prompt(feature: Column, options: Column, image: Column) -> Column:
    """``options``: an array of struct(value, description, photo, illustration), in the order shown."""

    def shown(option: Column, ordinal: Column) -> Column:
        number = (ordinal + 1).cast("string")
        line = part("text", F.concat(F.lit("\n"), number, F.lit(". **"), option["value"], F.lit("**"), described(option["description"])))
        pictures = []
        for name, title in (("photo", "Reference photo for option "), ("illustration", "Botanical illustration for option ")):
            has = F.coalesce(option[name], F.lit("")) != ""
            pictures += [F.when(has, part("text", F.concat(F.lit(title), number, F.lit(":")))), F.when(has, part("image", option[name]))]
        return F.array_compact(F.array(line, *pictures))

    opening = F.array(part("image", image), part("text", filled(CHOICE, feature_name(feature))))
    last = F.concat(F.lit("\n"), (F.size(options) + 1).cast("string"), F.lit(f". **{CANNOT}**"))
    first_value = F.coalesce(F.get(options, F.lit(0))["value"], F.lit(""))
    return F.concat(opening, F.flatten(F.transform(options, shown)), F.array(part("text", last), part("text", filled(CHOICE_END, first_value))))


def parse_yes_no(answer: Column) -> Column:
    """YES, NO or INCONCLUSIVE.  The order of the tests matters: "NOT SURE" is NO, and so is "KNOWN"."""
    text = F.upper(answer)
    return (
        F.when(text.startswith("YES"), "YES").when(text.startswith("NO"), "NO").when(F.contains(text, F.lit("INC")), INCONCLUSIVE)
        .when(F.contains(text, F.lit("YES")), "YES").when(F.contains(text, F.lit("NO")), "NO").otherwise(INCONCLUSIVE)
    )


def parse_choice(answer: Column, values: Column) -> Column:
    """The value that an answer names: the whole answer, else the first one inside it, else by number."""

    def told(said: Column) -> Column:
        text, low = said["text"], said["low"]
        whole = F.get(F.filter(values, lambda v: F.lower(v) == low), F.lit(0))
        inside = F.get(F.filter(values, lambda v: F.contains(low, F.lower(v))), F.lit(0))
        number = F.regexp_extract(text, r"^([0-9]+)", 1).try_cast("int")
        numbered = F.when(number.between(1, F.size(values)), F.get(values, number - 1))
        return F.coalesce(whole, inside, F.when(~F.contains(low, F.lit("cannot determine")), numbered), F.lit(INCONCLUSIVE))

    return once(strip(answer), lambda text: once(F.struct(text.alias("text"), F.lower(text).alias("low")), told))


def mock_answer(parts: Column) -> Column:
    """What a stand-in model answers to a prompt."""
    text = F.lower(F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["value"]), "\n"))
    asks = F.contains(text, F.lit("answer only: yes, no, or inconclusive")) | F.contains(text, F.lit("reply with exactly one word: yes, no, or inconclusive"))
    return F.when(asks, INCONCLUSIVE).when(F.contains(text, F.lit(CANNOT.lower())), CANNOT).otherwise(INCONCLUSIVE)


def step_score(parsed: Column, truth: Column) -> Column:
    """struct(feature_correct, committed): an inconclusive answer is right but not committed."""
    right, open_ = parsed == truth, parsed == INCONCLUSIVE
    return F.struct((right | open_).alias("feature_correct"), (right | ~open_).alias("committed"))


def is_correct(outcome: Column, predicted: Column, truth: Column) -> Column:
    """Whether a classification is right; null for an abstained or invalid record."""
    return F.when(outcome == "classified", F.coalesce(predicted.eqNullSafe(truth), F.lit(False)))
