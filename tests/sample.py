"""A small graph of people, companies and projects, typed by hand."""

from tripleframe import vocab as V
from tripleframe.functions.terms import literal_key as lit

EX = V.EX


def quads():
    rows = []

    def add(s, p, o, g=None):
        rows.append((g, EX + s, p, o))

    for name in ("Person", "Company", "Project"):
        add(name, V.RDF_TYPE, V.RDFS + "Class")
        add(name, V.RDFS_LABEL, lit(name))
    for name, label in (
        ("worksFor", "works for"), ("knows", "knows"), ("contributesTo", "contributes to"),
        ("foundedBy", "founded by"), ("age", "age"), ("joined", "joined"),
    ):
        add(name, V.RDF_TYPE, V.RDF + "Property")
        add(name, V.RDFS_LABEL, lit(label))
    for name, founder in (("Acme", "alice"), ("Globex", "erin")):
        add(name, V.RDF_TYPE, EX + "Company")
        add(name, V.RDFS_LABEL, lit(name))
        add(name, EX + "foundedBy", EX + founder)
    people = {
        "alice": (32, "2020-06-01", "Acme", ["bob"], ["ProjectA"]),
        "bob": (41, "2018-01-15", "Acme", ["carol"], []),
        "carol": (29, "2022-11-04", "Globex", [], ["ProjectA", "ProjectB"]),
        "dan": (55, "2015-03-30", None, [], []),
        "erin": (37, None, None, ["alice"], []),
    }
    for name, (age, joined, firm, friends, projects) in people.items():
        add(name, V.RDF_TYPE, EX + "Person")
        add(name, V.RDFS_LABEL, lit(name.capitalize(), lang="en"))
        add(name, EX + "age", lit(age))
        if joined:
            add(name, EX + "joined", lit(joined, datatype=V.DATE))
        if firm:
            add(name, EX + "worksFor", EX + firm)
        for f in friends:
            add(name, EX + "knows", EX + f)
        for p in projects:
            add(name, EX + "contributesTo", EX + p)
    for name, label in (("ProjectA", "Apollo"), ("ProjectB", "Borealis"), ("ProjectC", "Cassini")):
        add(name, V.RDF_TYPE, EX + "Project")
        add(name, V.RDFS_LABEL, lit(label))
    g = EX + "employmentGraph"
    for firm in ("Acme", "Globex"):
        add(firm, V.RDF_TYPE, EX + "Company", g)
    for name, firm in (("alice", "Acme"), ("bob", "Acme"), ("carol", "Globex")):
        add(name, V.RDF_TYPE, EX + "Person", g)
        add(name, EX + "worksFor", EX + firm, g)
    return rows


SCHEMA = "g string, s string, p string, o string"
