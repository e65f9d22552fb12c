"""Code-security analytics on Spark: scanning, graphs, findings, search and evaluation."""

import sys

from pyspark import cloudpickle

from sparkwarden.session import build_session, reliable_checkpoint

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "reliable_checkpoint"]
