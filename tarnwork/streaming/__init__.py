from tarnwork.streaming.loops import complete_from, cycle, run_every  # noqa: F401
from tarnwork.streaming.pilot import Pilot  # noqa: F401
from tarnwork.streaming.operators import cooldown, job_events, queue_events, statistics, stuck  # noqa: F401
