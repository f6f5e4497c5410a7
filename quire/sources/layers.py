"""Optional content: which layers are on, and what of a page they hide."""

from __future__ import annotations

from dataclasses import dataclass, field

from .syntax import Name, PdfError, Ref

#: Bounds of one membership: nodes and depth of its expression.
NODES, DEPTH = 4096, 32


@dataclass
class Layers:
    """The default configuration: BaseState, then ON, then OFF, which wins. A file without OCProperties hides nothing."""

    doc: object
    state: dict[int, bool] = field(default_factory=dict)
    known: bool = False

    @classmethod
    def of(cls, doc) -> Layers:
        out = cls(doc)
        props = doc.get(doc.get(doc.trailer["Root"]).get("OCProperties"))
        if isinstance(props, dict):
            out.known = True
            conf = doc.get(props.get("D"))
            conf = conf if isinstance(conf, dict) else {}
            refs = lambda v: [r for r in doc.get(v) or [] if isinstance(r, Ref)]
            base = doc.get(conf.get("BaseState")) != "OFF"
            out.state = {r.num: base for r in refs(props.get("OCGs"))}
            out.state |= {r.num: True for r in refs(conf.get("ON"))}
            out.state |= {r.num: False for r in refs(conf.get("OFF"))}
        return out

    def visible(self, v) -> bool:
        """Whether what belongs to v shows: a group, a membership with a policy, or one with an expression. Broken ones show."""
        if not self.known or v is None:
            return True
        try:
            return self._shown(v)
        except (PdfError, AttributeError, TypeError):
            return True

    def _shown(self, v) -> bool:
        d = self.doc.get(v)
        if not isinstance(d, dict):
            return True
        if d.get("Type") != "OCMD":
            return self.state.get(v.num, True) if isinstance(v, Ref) else True
        if (ve := self.doc.get(d.get("VE"))) is not None:
            return self._expression(ve, 0, [0])
        groups = d.get("OCGs")
        inner = self.doc.get(groups)
        members = inner if isinstance(inner, list) else [groups] if inner is not None else []
        on = [self.state.get(r.num, True) for r in members if isinstance(r, Ref) and isinstance(self.doc.get(r), dict)]
        if not on:
            return True
        policy = self.doc.get(d.get("P"))
        return all(on) if policy == "AllOn" else not any(on) if policy == "AllOff" else not all(on) if policy == "AnyOff" else any(on)

    def _expression(self, v, depth: int, seen: list[int]) -> bool:
        """And, Or and Not over groups; an empty And is true, an empty Or false. Beyond the bounds, or not of that form: an error."""
        seen[0] += 1
        if depth > DEPTH or seen[0] > NODES:
            raise PdfError("optional-content")
        x = self.doc.get(v)
        if isinstance(x, list) and x and isinstance(self.doc.get(x[0]), Name):
            op, parts = self.doc.get(x[0]), x[1:]
            if op == "And":
                return all([self._expression(p, depth + 1, seen) for p in parts])
            if op == "Or":
                return any([self._expression(p, depth + 1, seen) for p in parts])
            if op == "Not" and len(parts) == 1:
                return not self._expression(parts[0], depth + 1, seen)
            raise PdfError("optional-content")
        if isinstance(v, Ref) and isinstance(x, dict):
            return self.state.get(v.num, True)
        raise PdfError("optional-content")
