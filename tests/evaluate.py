"""The rules over plain sets: an evaluator of its own that tests hold the engine against."""

from graphloom.functions import vocab as V

VOC = V.Vocabulary()


def literal(t):
    return t.startswith('"')


def closed(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def edges(triples, predicate):
    return {(s, o) for s, p, o in triples if p == predicate}


def plain(triples):
    return {t for t in triples if t[1] not in V.SCHEMA and t[1] != V.TYPE}


def one_run(base, ruleset):
    """All that one run of the phases derives, new or not."""
    sp = closed(edges(base, V.SUB_PROPERTY))
    while True:
        inherited = {(s, q, o) for s, p, o in plain(base) for a, q in sp if a == p}
        grown = closed(sp | edges(inherited, V.SUB_PROPERTY))
        if grown == sp:
            break
        sp = grown
    known = base | inherited
    data = plain(base) | plain(inherited)
    typed = {(s, V.TYPE, c) for s, p, _ in data for a, c in edges(known, V.DOMAIN) if a == p and not literal(s)}
    typed |= {(o, V.TYPE, c) for _, p, o in data for a, c in edges(known, V.RANGE) if a == p and not literal(o)}
    sc = closed(edges(known, V.SUB_CLASS))
    types = {t for t in known if t[1] == V.TYPE} | typed
    above = {(s, V.TYPE, d) for s, _, c in types for a, d in sc if a == c and not literal(s)}
    out = inherited | typed | above | {(a, V.SUB_PROPERTY, b) for a, b in sp} | {(a, V.SUB_CLASS, b) for a, b in sc}
    if ruleset == "rdfs":
        types |= above
        out |= {(p, V.TYPE, VOC.property) for _, p, _ in data} | {(p, V.SUB_PROPERTY, p) for _, p, _ in data}
        out |= {(x, V.TYPE, VOC.resource) for s, _, o in data for x in (s, o) if not literal(x)}
        of = lambda c: {s for s, _, o in types if o == c}
        out |= {(s, V.SUB_CLASS, VOC.resource) for s in of(VOC.klass)} | {(s, V.SUB_CLASS, s) for s in of(VOC.klass)}
        out |= {(s, V.SUB_CLASS, VOC.literal) for s in of(VOC.datatype)}
        new = {(s, VOC.member) for s in of(VOC.membership)}
        out |= {(a, V.SUB_PROPERTY, b) for a, b in new}
        new -= sp | edges(base, V.SUB_PROPERTY)
        out |= {(s, q, o) for s, p, o in data for a, q in new if a == p}
    return out


def entailed(given, ruleset="rhodf", axioms=False, mode="phased"):
    """The triples that are not given."""
    given, base = set(given), set(given)
    if axioms:
        base |= set(VOC.axioms())
        for p in {p for _, p, _ in given if p.startswith(V.MEMBERSHIP) and len(p) > len(V.MEMBERSHIP) + 1}:
            base |= {(p, V.TYPE, VOC.membership), (p, V.DOMAIN, VOC.resource), (p, V.RANGE, VOC.resource)}
    out = base | one_run(base, ruleset)
    while mode == "complete":
        more = out | one_run(out, ruleset)
        if more == out:
            break
        out = more
    return out - given
