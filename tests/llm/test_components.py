import random

from inkfold.llm.components import connected_components
from inkfold.llm.landing import Landing


def smallest(links):
    """The smallest id that each node reaches, by going over the links until nothing changes."""
    at = {x: x for link in links for x in link}
    while True:
        before = dict(at)
        for u, v in links:
            at[u] = at[v] = min(at[u], at[v])
        if at == before:
            return at


def found(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    rows = connected_components(df, Landing(spark, "components")).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.component for r in rows}


def test_components_against_a_plain_search(spark):
    r = random.Random(8)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(i, 2000) for i in range(1900, 2100) if i != 2000]
    mixed = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    links = [*chain, *star, *((u, v) for u, v in mixed if u != v)]
    r.shuffle(links)
    assert found(spark, links + links[:50]) == smallest(links)


def test_stars_and_no_links(spark):
    assert found(spark, [(5, 1), (7, 1), (1, 7), (9, 8)]) == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8}
    assert found(spark, []) == found(spark, [(3, 3)]) == {}
