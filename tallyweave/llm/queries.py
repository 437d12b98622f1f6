"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyweave.llm import decontaminate, filteraudit, licences, lmscore, mixing, neardup, periodic, pii, pivots, quality, secrets, substrings, toxicity

QUERIES = {f.__name__: f for f in (mixing.op1_mixing, neardup.op2_neardup, secrets.op3_secrets, pii.op4_personal, substrings.op5_substrings, decontaminate.op6_decontamination, lmscore.op7_lmscore, quality.op8_quality, toxicity.op9_toxicity, licences.op10_licences, filteraudit.op11_audit, pivots.op12_embeddings, periodic.op13_periodic)}

ORACLE_SQL = {"op2_neardup": neardup.ORACLE_SQL, "op1_mixing": mixing.ORACLE_SQL, "op10_licences": licences.ORACLE_SQL, "op5_substrings": substrings.ORACLE_SQL, "op3_secrets": secrets.ORACLE_SQL, "op4_personal": pii.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL, "op7_lmscore": lmscore.ORACLE_SQL, "op8_quality": quality.ORACLE_SQL, "op11_audit": filteraudit.ORACLE_SQL, "op12_embeddings": pivots.ORACLE_SQL, "op13_periodic": periodic.ORACLE_SQL}
