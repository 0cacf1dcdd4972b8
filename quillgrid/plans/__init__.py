"""Registered queries over the shared tables, each with an SQL statement of the same result."""

from quillgrid.plans import (  # noqa: F401
    form_plans,
    json_plans,
    parse_plans,
    profile_plans,
    search_plans,
    state_plans,
    stream_plans,
    text_plans,
    view_plans,
)
from quillgrid.plans.registry import oracles, queries  # noqa: F401
