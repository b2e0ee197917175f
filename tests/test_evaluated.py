"""Texts are brought to their normal form at few places of an expression: each place in a lambda or branch is worked out anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelpworks.functions.planning import is_incomplete, is_toc_like
from kelpworks.operators.cases import highlights, stated_facts
from kelpworks.operators.context import overlap_score
from kelpworks.operators.intents import floor_filter, planning_intent, postprocessed, query_intents, query_profile
from kelpworks.operators.listing import price_vnd, utility_groups

#: Expressions over two texts by name, with the most places that have a normal form.
MADE = {
    "stated_facts": (lambda a, b: stated_facts(a), 7), "highlights": (highlights, 2), "is_toc_like": (lambda a, b: is_toc_like(a), 1), "is_incomplete": (lambda a, b: is_incomplete(a), 3),
    "price_vnd": (lambda a, b: price_vnd(a), 1), "floor_filter": (lambda a, b: floor_filter(a), 1), "utility_groups": (lambda a, b: utility_groups(a), 1),
    "overlap_score": (lambda a, b: overlap_score(a, b, [], F.array().cast("array<string>")), 3), "postprocessed": (postprocessed, 7),
    "planning_intent": (lambda a, b: planning_intent(a), 3), "query_intents": (lambda a, b: query_intents(a), 1), "query_profile": (lambda a, b: query_profile(a), 4),
}


@pytest.mark.parametrize("name", MADE)
def test_normal_forms_are_worked_out_once(spark, name):
    make, most = MADE[name]
    assert make(F.concat("a", F.lit("")), F.col("b"))._jc.toString().count("translate(") <= most


def test_facts_and_highlights_keep_their_order_and_first_forms(spark):
    text = F.lit("- Giá: 2 tỷ\n- GIA: 2 ty\n2) quận Ba Đình\nlời chào")
    listed = F.lit("Gần trường học| |HỒ BƠI|gần trường mầm non")
    row = spark.range(1).select(stated_facts(text).alias("f"), highlights(F.lit("có trường nào gần không"), listed).alias("h"), highlights(F.lit("?"), listed).alias("none")).first()
    assert row == ("Giá: 2 tỷ\nquận Ba Đình", "Gần trường học; gần trường mầm non", "Gần trường học; HỒ BƠI")
