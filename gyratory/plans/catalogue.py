"""Everything registered, in one place."""

from gyratory.plans import q_windows, q_labels, q_prep, q_metrics, q_sources, q_stream_models, q_workflows  # noqa: F401
from gyratory.plans.registry import ORACLES, QUERIES  # noqa: F401
