"""Knowledge-store analytics on Spark: ranked search, dedup, lifecycle rules, change logs, code graphs."""
