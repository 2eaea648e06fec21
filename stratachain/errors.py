"""Errors about a user's spec: a message for people, fields for machines."""

from __future__ import annotations

CODES = (
    "parse empty_spec unsupported_syntax unknown_op foreign_spelling spelling_convention boolean_operator modifier_misuse arity unknown_kwarg symbol_literal "
    "groupby_literal groupby_key order_entry unknown_column bare_name target_placeholder shape invalid_spec"
).split()


class SpecError(ValueError):
    """``span``: byte range of ``token`` in the stripped ``spec``; ``fix``: a drop-in text for the span, or None."""

    def __init__(self, msg: str, code: str = "invalid_spec", token: str | None = None, fix: str | None = None, span: tuple[int, int] | None = None, spec: str | None = None):
        super().__init__(msg)
        self.msg, self.code, self.token, self.fix, self.span, self.spec = msg, code, token, fix, span, spec

    def within(self, kind: str, spec: str) -> SpecError:
        """The same error, naming the spec it stands in; once only."""
        if self.spec is not None:
            return self
        span = self.span
        if span is not None:
            span = tuple(len(spec[:i].encode()) for i in span)
        return SpecError(f'parse{kind}: {self.msg} [in {kind}"{spec}"]', self.code, self.token, self.fix, span, spec)
