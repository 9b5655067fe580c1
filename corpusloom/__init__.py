"""corpusloom: governed-corpus analytics and corpus preparation as Spark jobs."""
