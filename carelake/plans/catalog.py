"""Import every query module so that its queries register themselves."""

from carelake.plans import analytics_queries, cleaning_queries, load_queries, patient_queries, streaming_queries  # noqa: F401
