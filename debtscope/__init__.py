"""Code-quality analytics over corpora of source files, expressed as Spark DataFrame plans."""
