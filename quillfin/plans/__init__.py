"""The registered queries."""

from quillfin.plans import insider_queries as insider_queries
from quillfin.plans import io_queries as io_queries
from quillfin.plans import macro_queries as macro_queries
from quillfin.plans import more_queries as more_queries
from quillfin.plans import option_queries as option_queries
from quillfin.plans import relational_queries as relational_queries
from quillfin.plans import retrieval_queries as retrieval_queries
from quillfin.plans import source_queries as source_queries
from quillfin.plans import stream_queries as stream_queries
from quillfin.plans import text_queries as text_queries
from quillfin.plans import timeseries_queries as timeseries_queries
from quillfin.plans.registry import ORACLES as ORACLES
from quillfin.plans.registry import QUERIES as QUERIES
