"""Column-level functions (Column -> Column), all native Spark expressions."""
from .features import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .arrays import *  # noqa: F401,F403
