"""The RDF and RDFS vocabulary, and the axiomatic triples."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _rdf(name: str) -> str:
    return f"<{RDF}{name}>"


def _rdfs(name: str) -> str:
    return f"<{RDFS}{name}>"


SUB_CLASS, SUB_PROPERTY = _rdfs("subClassOf"), _rdfs("subPropertyOf")
DOMAIN, RANGE, TYPE = _rdfs("domain"), _rdfs("range"), _rdf("type")
SCHEMA = (SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)
#: A predicate that starts so and is longer is a container membership property.
MEMBERSHIP = f"<{RDF}_"


@dataclass(frozen=True)
class Vocabulary:
    """Classes that rules name. "w3c" has Property in rdf: and Datatype in rdfs:, "compat" the other way round."""

    kind: str = "compat"
    resource: str = _rdfs("Resource")
    klass: str = _rdfs("Class")
    literal: str = _rdfs("Literal")
    membership: str = _rdfs("ContainerMembershipProperty")
    member: str = _rdfs("member")
    property: str = field(init=False)
    datatype: str = field(init=False)

    def __post_init__(self):
        if self.kind not in ("compat", "w3c"):
            raise ValueError(f"vocabulary {self.kind!r}: compat or w3c")
        compat = self.kind == "compat"
        object.__setattr__(self, "property", _rdfs("Property") if compat else _rdf("Property"))
        object.__setattr__(self, "datatype", _rdf("Datatype") if compat else _rdfs("Datatype"))

    def axioms(self) -> list[tuple[str, str, str]]:
        """The 38 axiomatic triples that hold for any data."""
        statement, list_ = _rdfs("Statement"), _rdf("List")
        # The axioms' terms.
        domains = {
            self.resource: [TYPE, self.member, _rdfs("seeAlso"), _rdfs("isDefinedBy"), _rdfs("comment"), _rdfs("label"), _rdf("value")],
            self.property: [DOMAIN, RANGE, SUB_PROPERTY, SUB_CLASS],
            statement: [_rdf("subject"), _rdf("predicate"), _rdf("object")],
            list_: [_rdf("first"), _rdf("rest")],
        }
        ranges = {
            self.klass: [TYPE, DOMAIN, RANGE, SUB_CLASS],
            self.property: [SUB_PROPERTY],
            self.resource: [_rdf("subject"), _rdf("predicate"), _rdf("object"), self.member, _rdf("rest"), _rdfs("seeAlso"), _rdfs("isDefinedBy"), _rdf("value")],
            self.literal: [_rdfs("comment"), _rdfs("label")],
        }
        above = {
            _rdfs("Container"): [_rdf("Alt"), _rdf("Bag"), _rdf("Seq")],
            self.property: [self.membership],
            self.literal: [_rdf("XMLLiteral")],
            self.klass: [self.datatype],
        }
        out = [(s, p, o) for p, m in ((DOMAIN, domains), (RANGE, ranges), (SUB_CLASS, above)) for o, ss in m.items() for s in ss]
        return [*out, (_rdf("XMLLiteral"), TYPE, self.datatype)]
