"""Sales-channel analytics and support-ticket triage on Spark DataFrames."""
