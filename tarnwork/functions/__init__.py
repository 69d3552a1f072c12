from tarnwork.functions import columns  # noqa: F401
from tarnwork.functions.columns import *  # noqa: F403
