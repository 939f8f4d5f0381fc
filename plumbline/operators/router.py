"""Which way a question is answered: from the drawing, the specification, the picture, or drawing and specification together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell where a question belongs. ``(?U)`` makes \b and \w know all letters.
CHECK = r"(?U)\b(compl(y|ies|iant|iance)|meet|meets|satisf(y|ies)|violat\w*|pass(es)?|fail(s)?|conform\w*|permitted by|allowed by|as the spec requires|per the spec|correctly|within|according to)\b"
RULE = r"(?U)\b(spec|specification|minimum|required|requires|rule|clause|standard)\b"
SEEN = r"(?U)\b(where|located|location|layout|look like|looks like|describe the (drawing|plan|layout)|left|right|above|below|next to|adjacent|beside|arrangement|orient\w*|north|south|east|west|opposite|side of)\b"
SPEC = r"(?U)\b(spec|specification|required|requirement|minimum|maximum|shall|allowed|permitted|must|need|needed|should|standard|clause|rule|submission|reviewer|alarm)\b"
DRAWN = r"(?U)\b(this (drawing|plan|part|file)|the (drawing|plan|part)|in the plan|in the drawing|how many|count|total|largest|smallest|overall)\b"

ROUTES = ("compute", "spec", "visual", "compliance")


def route(question: Column, has_drawing: Column | None = None, has_spec: Column | None = None) -> Column:
    """The route of a question by its words; what is at hand defaults to both. A null question is routed like an empty one."""
    text = F.lower(F.coalesce(question, F.lit("")))
    drawing = F.coalesce(has_drawing, F.lit(False)) if has_drawing is not None else F.lit(True)
    spec = F.coalesce(has_spec, F.lit(False)) if has_spec is not None else F.lit(True)
    seen = text.rlike(SEEN)
    return (
        F.when(~spec, F.when(seen, "visual").otherwise("compute"))
        .when(~drawing, "spec")
        .when(text.rlike(CHECK) & text.rlike(RULE), "compliance")
        .when(seen, "visual")
        .when(text.rlike(SPEC) & ~text.rlike(DRAWN), "spec")
        .otherwise("compute")
    )


def constrained(reply: Column, fallback: Column, has_drawing: Column, has_spec: Column) -> Column:
    """The route that a language model's reply names by its first word, bent to what is at hand; ``fallback`` where it names none."""
    word = F.regexp_extract(F.lower(F.coalesce(reply, F.lit(""))), r"[a-z]+", 0)
    named = (
        F.when(word.isin("spec", "compliance") & ~has_spec, "compute")
        .when(word.isin("compute", "visual", "compliance") & ~has_drawing, "spec")
        .otherwise(word)
    )
    return F.when(word.isin(*ROUTES), named).otherwise(fallback)
