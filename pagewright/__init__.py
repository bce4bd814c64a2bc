"""Page-layout and OCR-quality analytics on Spark."""
