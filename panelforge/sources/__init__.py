"""Panels: where bars come from, and the dense grid they are put on."""
