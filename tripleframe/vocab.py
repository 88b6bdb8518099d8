"""Namespaces and other fixed values shared by the library."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
EX = "http://example.org/"

RDF_TYPE = RDF + "type"
RDFS_LABEL = RDFS + "label"

# Prefixes every caller may use without declaring them.
DEFAULT_PREFIXES = {
    "rdf": RDF,
    "rdfs": RDFS,
    "owl": OWL,
    "xsd": XSD,
    "skos": SKOS,
    "dct": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
}

# Prefixes known to the result and metric comparison.
EVAL_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL, "ex": EX}

# Numeric datatypes by promotion rank.
INTEGER_TYPES = [
    XSD + t
    for t in (
        "integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger",
        "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort",
        "unsignedByte",
    )
]
DECIMAL, FLOAT, DOUBLE = XSD + "decimal", XSD + "float", XSD + "double"
BOOLEAN, DATE, DATETIME = XSD + "boolean", XSD + "date", XSD + "dateTime"

# The shapes of an absolute IRI and of the local part of a prefixed name.
ABSOLUTE_IRI = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]+$"
LOCAL_NAME = r"^[A-Za-z0-9_][A-Za-z0-9_\-.~]{0,255}$"
