"""tallyspark: project-portfolio analytics expressed as Spark DataFrame plans.

Work-hour facts and a project dimension go in; labor cost, profit, a wide
feature table, rule and model anomalies, weighted risk scores and report
tables come out.  Every operator takes and returns a ``DataFrame``; the only
actions are model fits (small, bounded results) and sinks.
"""

__version__ = "0.1.0"
