"""Domain packs: words of a trade as data, from which tables get their meanings and their analyses.

A pack names a domain, the words that give it away (anchors; identity anchors weigh more) and its concepts with their aliases. Nothing of a domain
is in code: a pack added as JSON takes part like any other. Fields are matched to concepts by name, and their roles come from column profiles.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.expressions import col, month_text
from tabloom.operators import aggregate
from tabloom.operators.order import Outputs
from tabloom.operators.quality import profile_columns
from tabloom.operators.relational import OperatorError
from tabloom.reports.adaptive import SUMMARY, roles

#: What a word counts in the request, in the names of tables and in the names of fields; and a concept with a field.
IDENTITY, ANCHOR, CONCEPT = (20.0, 8.0, 3.0), (4.0, 2.0, 1.0), 0.35
#: Confidence of a field that is called like an alias, and of one that holds one or is held by it.
EXACT, PARTIAL = 1.0, 0.78


@dataclass(frozen=True)
class Pack:
    id: str
    label: str
    anchors: tuple[str, ...]
    identity_anchors: tuple[str, ...]
    concepts: dict[str, tuple[str, ...]]
    #: concept -> how its values are summed up (an aggregation's name); others by their fields' names
    measures: dict[str, str]


def _words(x, what: str) -> tuple[str, ...]:
    if not isinstance(x, list) or not all(isinstance(w, str) and w.strip() for w in x):
        raise OperatorError(f"{what} must be a list of words")
    return tuple(w.strip() for w in x)


def load_packs(text: str | dict) -> list[Pack]:
    """Packs of {"schema_version": 1, "domains": [{id, label, anchors, identity_anchors, concepts, measures}]}; anything else is an error."""
    try:
        data = json.loads(text) if isinstance(text, str) else text
    except ValueError as e:
        raise OperatorError(f"domain packs are not readable: {e}") from e
    if not isinstance(data, dict) or data.get("schema_version") != 1 or not isinstance(data.get("domains"), list) or not data["domains"]:
        raise OperatorError("domain packs have schema_version 1 and a list of domains")
    packs = []
    for d in data["domains"]:
        if not isinstance(d, dict) or not all(isinstance(d.get(k), str) and d[k].strip() for k in ("id", "label")) or not isinstance(d.get("concepts"), dict) or not d["concepts"]:
            raise OperatorError("a domain has an id, a label and concepts")
        concepts = {c: _words(a, f"the aliases of {c}") for c, a in d["concepts"].items()}
        if not all(concepts.values()):
            raise OperatorError(f"{d['id']}: a concept without aliases")
        measures = dict(d.get("measures", {}))
        if set(measures) - set(concepts) or not all(m in ("known_sum", "sum", "mean", "max", "min", "count") for m in measures.values()):
            raise OperatorError(f"{d['id']}: measures name concepts and known aggregations")
        packs.append(Pack(d["id"].strip(), d["label"].strip(), _words(d.get("anchors"), "anchors"), _words(d.get("identity_anchors", []), "identity_anchors"), concepts, measures))
    if len({p.id for p in packs}) < len(packs):
        raise OperatorError("two domains have one id")
    return packs


def plain(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).casefold()


def domain_score(pack: Pack, request: str, tables: dict[str, list[str]]) -> float:
    """How much the request, the tables' names and their fields' names speak for a domain."""
    texts = (plain(request), plain(" ".join(tables)), plain(" ".join(c for cs in tables.values() for c in cs)))
    score = sum(w for words, weights in ((pack.identity_anchors, IDENTITY), (pack.anchors, ANCHOR)) for a in words for t, w in zip(texts, weights) if plain(a) and plain(a) in t)
    return score + CONCEPT * sum(any(plain(a) in texts[2] for a in aliases if plain(a)) for aliases in pack.concepts.values())


def choose_domain(packs: list[Pack], request: str, tables: dict[str, list[str]]) -> tuple[Pack, float]:
    """The pack with the highest score (ties: the earlier one), and a confidence between 0.15 and 0.99 by its lead."""
    scores = [domain_score(p, request, tables) for p in packs]
    best = max(scores)
    second = sorted(scores)[-2] if len(scores) > 1 else 0.0
    return packs[scores.index(best)], min(0.99, max(0.15, 0.45 + (best - second) / max(best + 4.0, 8.0))) if best else 0.15


def match_concept(field: str, concepts: dict[str, tuple[str, ...]]) -> tuple[str, float]:
    """The concept whose longest alias the field's name is, else holds or is held by; ("", 0) for none."""
    name = plain(field)
    pairs = [(c, plain(a)) for c, aliases in concepts.items() for a in aliases if plain(a)]
    same = [(len(a), c) for c, a in pairs if a == name]
    part = [(min(len(a), len(name)), c) for c, a in pairs if name and (a in name or name in a)]
    for found, sure in ((same, EXACT), (part, PARTIAL)):
        if found:
            most = max(n for n, _ in found)
            return next(c for n, c in found if n == most), sure
    return "", 0.0


def compile_domain(tables: dict[str, DataFrame], packs: list[Pack], request: str = "", top: int = 10) -> Outputs:
    """domain (one row), fields (table, field, role, concept, confidence, aggregation), and for each table a ranking of every additive concept by each dimension and its months.

    Roles come from the profile of each table (a pass for a table): dates, identifiers, categories as dimensions, numbers as metrics; outputs are named
    `<table>:<concept>_by_<concept>` and `<table>:<concept>_by_month`, built when asked for. Fields without a concept keep their own name.
    """
    if not tables:
        raise OperatorError("no table")
    spark = next(iter(tables.values())).sparkSession
    pack, sure = choose_domain(packs, request, {n: df.columns for n, df in tables.items()})
    rows, makers = [], {}
    for name, df in tables.items():
        kinds, named = {r.column_name: r.semantic_type for r in profile_columns(df).collect()}, roles(df)
        role = {c: "date" if k == "datetime" else "identifier" if k == "identifier" or named[c] == "identifier" else "dimension" if k in ("category", "boolean") else "metric" if k in ("integer", "number") else "description" for c, k in kinds.items()}
        concept = {c: match_concept(c, pack.concepts) for c in df.columns}
        title = {c: concept[c][0] or c for c in df.columns}
        how = {c: pack.measures.get(concept[c][0]) or SUMMARY.get(named[c], "known_sum") for c in df.columns if role[c] == "metric"}
        rows += [(name, c, role[c], *concept[c], how.get(c)) for c in df.columns]
        date = [c for c in df.columns if role[c] == "date"]
        for m, agg in how.items():
            if agg == "last":
                continue
            value = col(m).cast("decimal(18,4)") if agg in ("known_sum", "sum") else col(m)
            for d in (c for c in df.columns if role[c] == "dimension"):
                makers[f"{name}:{title[m]}_by_{title[d]}"] = lambda df=df, d=d, agg=agg, value=value: df.groupBy(col(d).alias("member")).agg(aggregate.aggregate(agg, value).alias("value"), F.count("*").alias("rows")).orderBy(F.desc_nulls_last("value"), "member").limit(top)
            if len(date) == 1:
                makers[f"{name}:{title[m]}_by_month"] = lambda df=df, agg=agg, value=value, at=date[0]: df.where(col(at).isNotNull()).groupBy(month_text(at).alias("month")).agg(aggregate.aggregate(agg, value).alias("value"))
    own = {"domain": lambda: spark.createDataFrame([(pack.id, pack.label, float(sure))], "id string, label string, confidence double"), "fields": lambda: spark.createDataFrame(rows, "table_name string, field string, role string, concept string, confidence double, aggregation string")}
    return Outputs({**own, **makers})
