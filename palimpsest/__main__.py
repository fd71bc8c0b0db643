import sys

from palimpsest.cli import main

sys.exit(main())
