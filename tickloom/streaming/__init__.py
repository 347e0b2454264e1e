"""Carry-over of series state from one daily run to the next."""
