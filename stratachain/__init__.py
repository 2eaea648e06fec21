"""Layered dimensions and aggregations over Spark DataFrames, by a small spec language."""

from .errors import SpecError
from .functions.registry import clear_caches, list_ops, op_shape, register_classifier, register_op
from .operators.chain import Dimension, Transform, agg, aggs, dim, dims
from .operators.hints import AggrHints, default_aggr, hints
from .operators.summary import describe
from .plans.specs import AggrSpec, DimSpec, HostSpec, check_cols, dimspec, fields, parse_aggr, parse_dim, summary, trusted

__all__ = [
    "AggrHints", "AggrSpec", "DimSpec", "Dimension", "HostSpec", "SpecError", "Transform", "agg", "aggs", "check_cols", "clear_caches", "default_aggr", "describe", "dim", "dims", "dimspec",
    "fields", "hints", "list_ops", "op_shape", "parse_aggr", "parse_dim", "register_classifier", "register_op", "summary", "trusted",
]
