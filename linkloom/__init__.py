"""Link-graph analytics on Spark: pages and links, dispositions, measures, triage, journals."""
