import sys

from tickerlake.cli import main

sys.exit(main())
