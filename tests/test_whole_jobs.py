"""Whole jobs against brute force."""

import random
import string

from firmlake.operators import entities


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(0, 240, 2):
        name = "".join(rng.choices(string.ascii_lowercase + " -", k=rng.choice((3, 9, 20, 63, 64, 65, 90))))
        k = rng.randrange(len(name))
        vector = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, name, f"https://site{i}.com", vector))
        typo = name[:k] + rng.choice(["", "x"]) + name[k + 1 :] if i % 4 else "other " + str(i) * 6
        rows.append((i + 1, typo, f"https://www.site{i % 30}.com/", [x + rng.gauss(0, 0.45) for x in vector]))
    rows += [(300 + i, "Northern Lights Fund", f"https://nl{i}.com", None) for i in range(250)]  # a name of more than 200 firms
    rows += [(601, None, None, [float("nan")] * 8), (602, "", "", [0.0] * 8), (603, "vc", "https://a-b.com", [1.0, 2.0]), (604, "x", "https://ab.com", [2.0, 4.0])]
    firms = spark.createDataFrame(rows, "id long, firm_name string, website string, embedding array<float>")
    ids = firms.select("id")
    every = entities.resolve_entities(firms, ids.toDF("a").crossJoin(ids.toDF("b")).where("a < b"))
    want = {(r.a, r.b): r for r in every.where("same_entity").collect()}
    assert {r.method for r in want.values()} == {"hybrid_resolution", "domain_match"} and len(want) > 31_125
    for out in (entities.resolve_entities(firms),):
        found = out.collect()
        got = {(r.a, r.b): r for r in found if r.same_entity}
        assert len(found) == len({(r.a, r.b) for r in found}) and got.keys() == want.keys()
        assert all(abs(got[k].confidence - r.confidence) <= 1e-4 and got[k].method == r.method and got[k].fuzzy == r.fuzzy for k, r in want.items())


def test_classes_hold_all_pairs(spark):
    """Classes, their members and the links between them, expanded, are the pairs; the rows stay about as many as firms."""
    rng = random.Random(8)
    names = ["".join(rng.choices(string.ascii_lowercase, k=14)) for _ in range(12)]
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    sites = ["https://a-b.com", "https://ab.com", "https://c.com/x", "https://c.com/y", "", None, "a b", "https://a b"]
    rows = []
    for i in range(240):
        name, vector = rng.choice(names), rng.choice(vectors)
        rows.append((i * 7 % 240, name + "s" if i % 5 == 0 else name, rng.choice(sites) if i % 3 == 0 else f"https://own{i}.com", [x + 0.1 for x in vector] if i % 4 == 0 else vector if i % 9 else None))
    firms = spark.createDataFrame(rows, "id long, firm_name string, website string, embedding array<double>")
    found = entities.resolve_classes(firms).collect()
    want = {(r.a, r.b) for r in entities.resolve_entities(firms).where("same_entity").collect()}
    domain = {r.id: r.domain for r in entities._marked(firms).collect()}
    got = set()
    for kind in ("name", "vector", "site"):
        rep = {r.b: r.a for r in found if {f"same_{kind}", "after_site" if kind == "site" else ""} & set(r.via)}
        alone, near = {r.a for r in found if f"near_{kind}" in r.via}, {(r.a, r.b) for r in found if f"near_{kind}" in r.via}
        members = {}
        for i in range(240):
            if i in rep or i in rep.values() or i in alone or kind != "site" and any((i in p) for p in near):
                members.setdefault(rep.get(i, i), []).append(i)
        for m in members.values():
            got |= {(x, y) for x in m for y in m if x < y and (kind != "site" or domain[x])}
        got |= {tuple(sorted((x, y))) for p in near for x in members[p[0]] for y in members[p[1]] if x != y}
    assert got == want and len(found) < 1_000 < 4_000 < len(want)
    assert all(r.same_entity for r in found if set(r.via) != {"same_domain"}) and len(found) == len({(r.a, r.b) for r in found})
