"""The deterministic resolver and the classes of its outcomes, as CASE ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(states: DataFrame) -> DataFrame:
    """Add ``action`` and ``challenged`` to one row a case.

    Columns: ``decision`` (supported or not), ``child_label``, ``attack``, ``attack_type``,
    ``alternative``, ``valid`` (null: the attack was not examined), ``scope``, ``independent``,
    ``protected``.  Null flags but ``valid`` count as false, null texts as empty.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    survives = ~flag("attack") | ~flag("valid")
    better = (text("attack_type") == "better_supported_alternative") & (text("alternative") != "")
    established = better & flag("independent")
    open_case = F.when(flag("protected") & survives, "protected_incumbent").when(flag("protected") & flag("valid") & established, "switch").otherwise("abstain")
    held = F.when(text("child_label") != "", "maintain").otherwise("family_fallback")
    rival = flag("attack") & F.col("valid").isNotNull() & ~flag("valid") & established
    narrowed = (text("attack_type") == "unsupported_specificity") | (text("scope") == "child_only")
    supported_case = F.when(rival, "abstain").when(survives, held).when(narrowed, "family_fallback").when(better, "switch").otherwise("abstain")
    action = F.when(text("decision") == "supported", supported_case).otherwise(open_case)
    return states.withColumns({"action": action, "challenged": flag("attack") & flag("valid")})


def resolution_basis(action: Column, challenged: Column) -> Column:
    """Class of an outcome: confident, clean_pass, evidence_rescue, abstain or other."""
    return F.when(action == "abstain", "abstain").when(action.isin("maintain", "switch") & challenged, "confident").when(action == "maintain", "clean_pass").when(action.isin("protected_incumbent", "family_fallback"), "evidence_rescue").otherwise("other")
