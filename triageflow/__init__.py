"""triageflow: security-alert triage analytics as Spark DataFrame jobs.

Layout
------
sources/    table readers, fixture derivations, CSV/JSON/model I/O, profiling
functions/  Column-expression builders (text assembly, rules, strict JSON, labels)
operators/  DataFrame -> DataFrame operators (metrics, sampling, text ML, prompts,
            answer parsing, hybrid records)
plans/      end-to-end jobs and the query registry used by ``__spark_entry__``
streaming/  Structured Streaming scoring jobs
"""

from triageflow.session import build_session, configure, checkpoint_root

__all__ = ["build_session", "configure", "checkpoint_root"]
