"""The ten named datasets and the pipeline that builds one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edits import inject_values, refuse_stories, swap_values
from ..operators.predicates import keep, story_filter
from ..operators.render import render


@dataclass(frozen=True)
class Recipe:
    """Options of one dataset; every field is a spec string or ``None``."""

    filtering: str | None = None
    mix_match: str | None = None
    adversarial_training: str | None = None
    refusal: str | None = None
    instruction_subset: str | None = None


def named_recipes(deleted: str = "Twist", irrelevant: str = "Foreshadowing") -> dict[str, Recipe]:
    """The datasets of a deletion and recovery study of two features."""
    a, b = deleted, irrelevant
    without, only_b = f"features!={a}", f"features!={a},features={b}"
    inject, swap = f"features={a}:1.0", f"features={b}:{a}"
    return {
        f"pretrain-no-{b}": Recipe(f"features!={b}"),
        f"recovery-{a}": Recipe(f"features={a}"),
        f"filter-{a}": Recipe(without),
        f"filter-{a}-specialise-{b}": Recipe(only_b),
        f"filter-adv-{a}": Recipe(without, adversarial_training=inject),
        f"filter-adv-{a}-specialise-{b}": Recipe(only_b, adversarial_training=inject),
        f"filter-mix-{a}-{b}": Recipe(without, mix_match=swap),
        f"filter-mix-specialise-{a}-{b}": Recipe(only_b, mix_match=swap),
        f"filter-ref-{a}": Recipe(without, refusal=inject),
        f"filter-ref-{a}-specialise-{b}": Recipe(only_b, refusal=inject),
    }


def edited(df: DataFrame, recipe: Recipe, seed: int = 0) -> DataFrame:
    """Filter, swap, inject, refuse; in this order."""
    return (
        keep(df, recipe.filtering)
        .transform(swap_values(recipe.mix_match))
        .transform(inject_values(recipe.adversarial_training, seed))
        .transform(refuse_stories(recipe.refusal, seed))
    )


def build_text(df: DataFrame, recipe: str | Recipe, seed: int = 0) -> DataFrame:
    """Rendered text of a dataset."""
    options = named_recipes()[recipe] if isinstance(recipe, str) else recipe
    return render(edited(df, options, seed), options.instruction_subset, seed)


def recipe_counts(df: DataFrame, recipes: dict[str, Recipe] | None = None) -> DataFrame:
    """Rows each dataset keeps, for all datasets in one scan."""
    recipes = recipes or named_recipes()
    sums = df.agg(
        *[
            F.sum(F.coalesce(story_filter(r.filtering), F.lit(False)).cast("bigint")).alias(name)
            for name, r in recipes.items()
        ]
    )
    return sums.unpivot([], list(recipes), "recipe", "kept")


# Option labels, and the replacements that make a name safe, in this order.
OPTION_LABELS = {
    "F": "filtering",
    "MM": "mix_match",
    "AT": "adversarial_training",
    "RF": "refusal",
    "IS": "instruction_subset",
}
SAFE_NAME = (("None", "none"), ("!=", "_x_"), ("=", "_"), (",", "_"), (":", "_"))


def dataset_name(recipe: Recipe) -> str:
    """Folder-safe name of one spec."""
    text = "_".join(f"{label}_{getattr(recipe, option)}" for label, option in OPTION_LABELS.items())
    for old, new in SAFE_NAME:
        text = text.replace(old, new)
    return text


def dataset_name_column(**options: Column) -> Column:
    """The same name over a table of specs; an option left out or null is no option."""
    missing = F.lit("None")
    parts = []
    for label, option in OPTION_LABELS.items():
        parts += [F.lit(label), F.coalesce(options.get(option, missing), missing)]
    text = F.concat_ws("_", *parts)
    for old, new in SAFE_NAME:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
