"""Model-written audit reports: JSON that may be broken or lack parts, read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFORTS = ["LOW", "MEDIUM", "HIGH"]
_ISSUE = "struct<title:string,impact:string,evidence:string,affectedUrls:array<string>>"
_ADVICE = "struct<priority:double,action:string,rationale:string,expectedImpact:string,effort:string>"
AUDIT = (
    f"struct<summary:string,score:double,seoHealth:string,criticalIssues:array<{_ISSUE}>,highPriorityIssues:array<{_ISSUE}>,"
    "internalLinking:struct<diagnosis:string,wastedPageRank:string,pagesToBoost:array<string>,recommendations:array<string>>,"
    f"geo:struct<readiness:string,gaps:array<string>,recommendations:array<string>>,recommendations:array<{_ADVICE}>,implementationOrder:array<string>>"
)


def audit_report(text: Column) -> Column:
    """The report as a struct, null without a summary or a score from 0 to 100; list elements that lack a part are left out."""
    x = F.from_json(text, AUDIT, {"mode": "PERMISSIVE"})
    empty = lambda c, kind: F.coalesce(c, F.from_json(F.lit("[]"), f"array<{kind}>"))
    issue = lambda i: F.struct(i["title"].alias("title"), i["impact"].alias("impact"), F.coalesce(i["evidence"], F.lit("")).alias("evidence"), empty(i["affectedUrls"], "string").alias("affectedUrls"))
    issues = lambda c: F.transform(empty(F.filter(c, lambda i: i["title"].isNotNull() & i["impact"].isNotNull()), _ISSUE), issue)
    good = lambda r: r["priority"].isNotNull() & r["action"].isNotNull() & F.coalesce(r["effort"].isin(EFFORTS), F.lit(True))
    advice = lambda r: F.struct(r["priority"].alias("priority"), r["action"].alias("action"), F.coalesce(r["rationale"], F.lit("")).alias("rationale"), F.coalesce(r["expectedImpact"], F.lit("")).alias("expectedImpact"), F.coalesce(r["effort"], F.lit("MEDIUM")).alias("effort"))
    whole = F.struct(
        x["summary"].alias("summary"), x["score"].alias("score"), F.coalesce(x["seoHealth"], F.lit("")).alias("seoHealth"), issues(x["criticalIssues"]).alias("criticalIssues"), issues(x["highPriorityIssues"]).alias("highPriorityIssues"),
        x["internalLinking"].alias("internalLinking"), x["geo"].alias("geo"), F.transform(empty(F.filter(x["recommendations"], good), _ADVICE), advice).alias("recommendations"), empty(x["implementationOrder"], "string").alias("implementationOrder"),
    )
    return F.when(x["summary"].isNotNull() & x["score"].between(0, 100), whole)
