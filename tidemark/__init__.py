"""tidemark: walk-forward analytics over keyed, time-ordered draws, expressed as Spark plans."""
