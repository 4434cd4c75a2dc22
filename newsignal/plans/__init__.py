"""Reports, views and the pipeline, composed of operators."""
