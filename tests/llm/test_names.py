from tesserae.llm import names as N

S = "id string, name string, entity_type string, aliases array<string>, form string, identity string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], S)
    return {tuple(r) for r in N.pairs(N.variants(df)).collect()}


def every(*groups):
    return {(a, b) for g in groups for a in g for b in g if a < b}


def test_persons(spark):
    rows = [
        ("a1", "Susan L. Ralvanzenje", "person", None), ("a2", "Ralvanzenje Susan", "person", []), ("a3", "S. Ralvanzenje", "person", [""]), ("a4", "Susie", "person", ["S. Ralvanzenje"]), ("a5", "SUSAN RALVANZENJE", "person", ["team lead"]),
        ("a6", "Slsan Ralvanzenje", "person", None), ("a7", "sralvanzenje", "other", None), ("a8", "Sue Ralvanzemje", "person", None), ("b1", "Jürgen Ralvanzenje", "person", ["admin"]), ("b2", "jurgen.ralvanzenje", "person", None),
        ("c1", "Susan Tarkomdelvu", "person", None), ("d1", "Susie", "person", None), ("d2", None, "person", None), ("d3", " ", "person", [None]), ("a1", "Susan L. Ralvanzenje", "person", None),
    ]
    got = linked(spark, rows)
    assert every(["a1", "a2", "a3", "a4", "a5", "a6"], ["b1", "b2"]) <= got
    assert not any(x[0] != y[0] for x, y in got)


def test_ambiguous_forms_do_not_link(spark):
    rows = [("a", "Richard Filgolvolga", "person", None), ("b", "Rebecca Filgolvolga", "person", None), ("c", "R. Filgolvolga", "person", None), ("d", "R.T. Filgolvolga", "person", None), ("e", "Rich T. Filgolvolga", "person", None)]
    assert linked(spark, rows) <= every(["a", "d", "e"])


def test_organisations(spark):
    rows = [
        ("a1", "Noljirzukdo & Dekzampo Engineering Co.", "org", None), ("a2", "Company Noljirzukdo and Dekzampo Engineering", "org", None), ("a3", "NoljirzukdoDekzampoEngineering", "org", None), ("a4", "The Noljirzukdo & Dekzampo, Eng. (Co.)", "org", ["the vendor"]),
        ("a5", "Noljirzukdo & Dekzampo Engineeing Company", "other", None), ("a6", "NDEC", "org", ["Noljirzukdo & Dekzampo Eng"]), ("b1", "Noljirzukdo & Dekzampo Logistics Co.", "org", None), ("c1", "Viszukfarfa Technologies Ltd", "org", None), ("c2", "Viszukfarfa Technologies GmbH", "org", None),
        ("d1", "noljirzukdo engineering", "project", None),
    ]
    assert linked(spark, rows) == every(["a1", "a2", "a3", "a4", "a5", "a6"])


def test_empty_and_many_copies(spark):
    assert linked(spark, []) == set()
    rows = [(f"p{k:02d}", "Dorothy Sonbinfunso", "person", ["Dot"]) for k in range(30)] + [("q", "Dot Sonbinfunso", "person", None)]
    assert len(linked(spark, rows)) == 31 * 30 // 2


def test_one_apart():
    assert N.one_apart("susan", "slsan") and N.one_apart("timothy", "timtohy") and N.one_apart("john", "jon") and N.one_apart("a", "a")
    assert not N.one_apart("susan", "sulsen") and not N.one_apart("abc", "cba") and not N.one_apart("ab", "abcd")


def test_an_alias_counts_by_identities_not_by_bearers(spark):
    handles = [(f"h{k:02d}", f"@kin{k}li", "person", ["Margaret Tikpuklasno"]) for k in range(9)]
    assert linked(spark, handles) == every([r[0] for r in handles])  # nine records, 36 pairs
    generic = [(f"g{k:02d}", f"{g} {s}", "person", ["Lead Reviewer"]) for k, (g, s) in enumerate([("Susan", "Ralvanzenje"), ("Richard", "Filgolvolga"), ("Thomas", "Dekpirgolpa"), ("Harold", "Mardelrorda")])]
    assert linked(spark, generic + handles) == every([r[0] for r in handles])


def test_misspellings_are_followed_to_their_end(spark):
    spellings = ["Dorothy Sonbinfunsko"] * 5 + ["Dorothy Sonbinfunso"] * 4 + ["Dorothy Sonbinfuno"] * 3 + ["Dorothy Sonbinfun"] * 2 + ["Dorothy Sonbinfn"]
    assert linked(spark, [(f"p{k:02d}", x, "person", None) for k, x in enumerate(spellings)]) == every([f"p{k:02d}" for k in range(len(spellings))])


def test_the_corpus_establishes_given_names(spark):
    rows = [(f"a{k}{g}", f"{n} {s}", "person", None) for k, s in enumerate(["Ralvanzenje", "Filgolvolga", "Dekpirgolpa", "Mardelrorda"]) for g, n in (("x", "Kenji"), ("y", "Kenja"))]
    assert linked(spark, rows) == set()  # relatives: both names are borne with many surnames
    turned = [("z", "Ralvanzenje Kenji", "person", None)]  # typed surname first
    assert linked(spark, rows + turned) == {("a0x", "z")}
    once = [("a", "Kenji Ralvanzenje", "person", None), ("b", "Kenji Filgolvolga", "person", None), ("c", "Kenji Dekpirgolpa", "person", None), ("d", "Kemji Dekpirgolpa", "person", None)]
    assert linked(spark, once) == {("c", "d")}


def test_rarity_of_partial_names(spark):
    rows = [("a", "Richard Filgolvolga", "person", None), ("b", "Rebecca Filgolvolga", "person", None), ("c", "R. Filgolvolga", "person", None), ("d", "Reb. Filgolvolga", "person", None)]
    got = {r.id: (r.identities, r.score) for r in N.rarities(spark.createDataFrame([(*r, "x", "y") for r in rows], S)).collect()}
    assert got == {"c": (2, 0.5), "d": (1, 1.0)}
