"""Document-structure analytics on Spark: outlines, headings, sections and the scores of competing segmentations."""
