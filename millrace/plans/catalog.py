"""Registration modules are imported here."""

from millrace.plans import text_queries  # noqa: F401
from millrace.plans import retrieval_queries  # noqa: F401
from millrace.plans import gate_queries  # noqa: F401
from millrace.plans import relational_queries  # noqa: F401
from millrace.plans import corpus_queries  # noqa: F401
from millrace.plans import rewrite_queries  # noqa: F401
from millrace.plans import dataset_queries  # noqa: F401
from millrace.plans import lookup_queries  # noqa: F401
from millrace.plans import context_queries  # noqa: F401
from millrace.plans import report_queries  # noqa: F401
from millrace.plans import phrase_queries  # noqa: F401
from millrace.plans import selective_queries  # noqa: F401
from millrace.plans import graph_queries  # noqa: F401
from millrace.plans import control_queries  # noqa: F401
