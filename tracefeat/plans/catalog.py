"""Import every query module so that the registry is complete."""

from tracefeat.plans import (q_encoders, q_evaluate, q_fitted, q_ml, q_prep, q_sequences, q_streaming,  # noqa: F401
                             q_user, q_windows)
from tracefeat.plans.registry import REGISTRY  # noqa: F401
