"""All queries of the library: importing the modules registers them."""

from quirefold.plans import checks, editing, imports, jobs, layout, pages, replies, states, streams, texts, typesetting  # noqa: F401
from quirefold.plans.registry import ORACLES, QUERIES  # noqa: F401
