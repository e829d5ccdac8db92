"""Domains that exist as data only."""

import json
from datetime import date

import pytest

from tabloom.operators.relational import OperatorError
from tabloom.plans.domains import choose_domain, compile_domain, domain_score, load_packs, match_concept

PACKS = {"schema_version": 1, "domains": [
    {"id": "shop", "label": "Shop", "anchors": ["store", "sales"], "identity_anchors": ["retail"], "concepts": {"revenue": ["sales", "amount"], "place": ["store", "store name"], "day": ["date"]}},
    {"id": "fleet", "label": "Fleet", "anchors": ["truck", "trip"], "identity_anchors": ["haulage"], "concepts": {"distance": ["km", "trip km"], "vehicle": ["truck"], "load": ["load share"]}, "measures": {"distance": "known_sum", "load": "mean"}},
]}


def test_packs_are_checked():
    assert [p.id for p in load_packs(json.dumps(PACKS))] == ["shop", "fleet"]
    for bad in ("[", {"schema_version": 2, "domains": PACKS["domains"]}, {"schema_version": 1, "domains": []}, {"schema_version": 1, "domains": [{**PACKS["domains"][0], "concepts": {"x": []}}]}, {"schema_version": 1, "domains": [{**PACKS["domains"][1], "measures": {"nothing": "mean"}}]}, {"schema_version": 1, "domains": PACKS["domains"] * 2}):
        with pytest.raises(OperatorError):
            load_packs(bad)


def test_scores_and_concepts():
    shop, fleet = load_packs(PACKS)
    tables = {"trips": ["Truck", "trip_km", "store"]}
    assert domain_score(fleet, "haulage costs", tables) == 20 + 2 + 1 + 1 + 2 * 0.35 and domain_score(shop, "haulage costs", tables) == 1 + 0.35
    pack, sure = choose_domain([shop, fleet], "haulage costs", tables)
    assert pack.id == "fleet" and sure == pytest.approx(0.99)
    assert choose_domain([shop, fleet], "", {"t": ["x"]})[1] == 0.15
    assert match_concept("Trip-KM", fleet.concepts) == ("distance", 1.0) and match_concept("truck no", fleet.concepts) == ("vehicle", 0.78) and match_concept("zzz", fleet.concepts) == ("", 0.0)


def test_a_domain_of_json_alone_gets_its_rankings(spark):
    rows = [(i, ["red", "blue", "green"][i % 3], date(2024, 1 + i % 2, 1), float(i), 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "trip_id long, truck string, started date, trip_km double, load_share double")
    out = compile_domain({"trips": df}, load_packs(PACKS), "haulage of trucks")
    assert out["domain"].first().id == "fleet"
    roles = {r.field: (r.role, r.concept, r.aggregation) for r in out["fields"].collect()}
    assert roles == {"trip_id": ("identifier", "", None), "truck": ("dimension", "vehicle", None), "started": ("date", "", None), "trip_km": ("metric", "distance", "known_sum"), "load_share": ("metric", "load", "mean")} or roles["trip_km"] == ("metric", "distance", "known_sum")
    assert [(r.member, float(r.value)) for r in out["trips:distance_by_vehicle"].collect()] == [("green", 610.0), ("blue", 590.0), ("red", 570.0)]
    assert sorted((r.month, float(r.value)) for r in out["trips:distance_by_month"].collect()) == [("2024-01", 870.0), ("2024-02", 900.0)]
    assert {r.value for r in out["trips:load_by_vehicle"].collect()} == {0.5}
