"""Surface forms of a name: company forms short and long, with and without a stop, and both ways to write `and`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import COMPANY_FORMS, clean_text, col

_EACH = {form: forms for forms in COMPANY_FORMS.values() for form in forms}

#: A name without any of this, wherever it stands in it, has no form but itself.
_MAY_VARY = r"(?iU)&|and|" + "|".join(_EACH) + r"|\s\s|[\s&&[^ ]]"


def _is_and(token: Column) -> Column:
    return (token == "&") | (F.lower(F.rtrim(token, F.lit("."))) == "and")


def and_variants(tokens: Column) -> Column:
    """The tokens joined by spaces, with each `&` or `and` token written both ways, in all combinations.

    The tokens are folded from the left; each `and` doubles the forms so far, any other token lengthens them.
    """
    glue = lambda form, t: F.when(form == "", t).otherwise(F.concat(form, F.lit(" "), t))
    step = lambda forms, t: F.when(_is_and(t), F.flatten(F.transform(forms, lambda f: F.array(glue(f, F.lit("&")), glue(f, F.lit("and")))))).otherwise(F.transform(forms, lambda f: glue(f, t)))
    return F.array_distinct(F.concat(F.array(F.array_join(tokens, " ")), F.aggregate(tokens, F.array(F.lit("")), step)))


def aliases(name: Column | str) -> Column:
    """All surface forms of a name, itself first; none of a blank name."""
    text = clean_text(col(name))
    tokens = F.split(text, r"(?U)\s+")
    last = F.lower(F.rtrim(F.element_at(tokens, -1), F.lit(".")))
    table = F.create_map(*(x for form, forms in _EACH.items() for x in (F.lit(form), F.array(*(F.lit(y) for f in forms for y in (f, f + "."))))))
    forms = F.element_at(table, last)
    stems = and_variants(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))))
    with_forms = F.flatten(F.transform(stems, lambda s: F.transform(forms, lambda f: F.concat(s, F.lit(" "), f))))
    rest = F.when(forms.isNull(), and_variants(tokens)).when(F.size(tokens) >= 2, with_forms).otherwise(F.array(text))
    every = F.when(~text.rlike(_MAY_VARY), F.array(text)).otherwise(F.array_distinct(F.concat(F.array(text), rest)))
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(every)


_EITHER = {"&": ["and", "&"], "and": ["and", "&"]}


def name_pattern(name: str) -> str:
    """A regular expression that matches every surface form, to cross-check `aliases`: the ways to write each word, between blanks."""
    core = lambda w: w.rstrip(".").lower()
    *head, last = name.split() or [""]
    ways = [_EITHER.get(core(w), [w]) for w in head] + [_EACH.get(core(last)) or _EITHER.get(core(last), [last])]
    return r"\s+".join("(?:" + "|".join(re.escape(w) for w in options) + ")" for options in ways)
