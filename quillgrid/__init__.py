"""quillgrid: document analytics expressed as Spark DataFrame plans."""
