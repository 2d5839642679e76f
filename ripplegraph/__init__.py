"""Part of ripplegraph."""
