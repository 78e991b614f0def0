"""tacita: personal-data detection, entity resolution and anonymisation over Spark DataFrames."""
