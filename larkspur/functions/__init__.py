"""Value rules: coercion on the way in, rendering on the way out."""
