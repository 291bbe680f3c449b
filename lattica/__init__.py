"""lattica: labelled images, weighted graphs and sample similarities as Spark relations."""
