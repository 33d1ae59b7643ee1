"""The language database: syntax classes, the languages of each, families and test markers, and the registry built from them.

A language takes its syntax from a class and may change single fields. Definitions can be overlaid by a nested dictionary, merged key by
key; every other value replaces what it meets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

OTHER, UNKNOWN = "Other", "Unknown"
Pairs = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Language:
    key: str
    name: str
    line: tuple[str, ...] = ()
    block: Pairs = ()
    inner: Pairs = ()
    quotes: Pairs = ()
    doc: Pairs = ()
    verbatim: Pairs = ()
    nested: bool = False
    literate: bool = False
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    test_paths: tuple[str, ...] = ()
    test_blocks: tuple[str, ...] = ()
    indent_style: bool = False
    family: str = OTHER

    @property
    def fortran(self) -> bool:
        return self.key in ("FortranModern", "FortranLegacy")

    @property
    def comments(self) -> Pairs:
        return self.block + self.inner

    @property
    def detects_tests(self) -> bool:
        return bool(self.test_blocks or self.test_paths)

    @property
    def bare(self) -> bool:
        """Whether every line is settled by its own start: no strings, blocks or test blocks."""
        return not (self.block or self.inner or self.quotes or self.doc or self.verbatim or self.test_blocks or self.literate or self.fortran)


#: Fields of a class: ``line`` has openers, ``block`` (pairs), ``inner`` (pairs that nest), ``quotes``, ``doc`` and ``verbatim`` have
#: openers and closers by turns, all parted by blanks; ␠ stands for a blank inside one.
CLASSES = {
    "plain": {},
    "c": {"line": "//", "block": "/* */", "quotes": '" "'},
    "c nested": {"line": "//", "block": "/* */", "quotes": '" "', "nested": True},
    "c two": {"line": "//", "block": "/* */", "quotes": "\" \" ' '"},
    "c bare": {"line": "//", "block": "/* */"},
    "js": {"line": "//", "block": "/* */", "quotes": "\" \" ' ' ` `"},
    "slashes": {"line": "//"},
    "slashes quoted": {"line": "//", "quotes": '" "'},
    "css": {"block": "/* */", "quotes": "\" \" ' '"},
    "sass": {"line": "//", "block": "/* */", "quotes": "\" \" ' '"},
    "hash": {"line": "#"},
    "hash one": {"line": "#", "quotes": '" "'},
    "hash two": {"line": "#", "quotes": "\" \" ' '"},
    "hash c": {"line": "# //", "block": "/* */", "quotes": '" "'},
    "python": {"line": "#", "quotes": "\" \" ' '", "doc": "\"\"\" \"\"\" ''' '''"},
    "semicolon": {"line": ";"},
    "semicolon quoted": {"line": ";", "quotes": '" "'},
    "lisp": {"line": ";", "block": "#| |#", "nested": True, "quotes": '" "'},
    "ml": {"block": "(* *)", "nested": True, "quotes": '" "'},
    "dash": {"line": "--"},
    "haskell": {"line": "--", "block": "{- -}", "nested": True},
    "sql": {"line": "--", "block": "/* */", "quotes": "' '"},
    "xml": {"block": "<!-- -->", "quotes": "\" \" ' '"},
    "percent": {"line": "%"},
    "basic": {"line": "'", "quotes": '" "'},
    "prose": {"literate": True},
    "org": {"line": "#", "literate": True},
}

#: Class, then entries ``Key[=Name][:extensions][@filenames]`` parted by blanks; an underscore in a name is a blank.
LANGUAGES = {
    "plain": "Json:json",
    "c": """C:c,ec,pgc CHeader=C_Header:h Cpp=C++:cc,cpp,cxx,c++,pcc,tpp CppHeader=C++_Header:hh,hpp,hxx,inl,ipp CppModule=C++_Module:cppm,ixx,ccm,mpp,mxx
        Java:java CSharp=C#:cs,csx ObjectiveC=Objective-C:m ObjectiveCpp=Objective-C++:mm Metal:metal Cuda=CUDA:cu Arduino=Arduino_C++:ino Glsl=GLSL:vert,tesc,tese,geom,frag,comp,mesh,task,rgen,rint,rahit,rchit,rmiss,rcall,glsl
        Hlsl=HLSL:hlsl OpenCL:ocl HolyC=HolyC:hc,zc C3:c3 Jai:jai Haxe:hx ActionScript=ActionScript:as Xtend:xtend Thrift:thrift Protobuf=Protocol_Buffers:proto Slang:slang ShaderLab:shader,cginc
        Swig=SWIG:i Solidity:sol Bicep:bicep Nextflow:nextflow,nf@nextflow.config BallerinaLang=Ballerina:bal Cangjie:cj Codeql=CodeQL:ql,qll Cairo:cairo Chapel:chpl Circom:circom Koka:kk Stan:stan Virgil:v3
        Verilog:vg,vh SystemVerilog=SystemVerilog:sv,svh Zokrates=ZoKrates:zok LinguaFranca=Lingua_Franca:lf Monkeyc=Monkey_C:mc RedScript=RedScript:reds Tact:tact ZenCode:zs FlatBuffers=FlatBuffers_Schema:fbs
        OpenScad=OpenSCAD:scad GameMaker=GML:gml Qcl=QCL:qcl OpenQasm=OpenQASM:qasm Slint:slint DeviceTree=Device_Tree:dts,dtsi LinkerScript=LD_Script:ld,lds Modelica:mo Poke:pk LalrPop=LALRPOP:lalrpop DreamMaker=Dreammaker:dm,dme XcodeConfig=Xcode_Config:xcconfig
        Headache:ha AssemblyGAS=GNU_Style_Assembly:s Unrealscript=Unreal_Script:uc Apex:trigger Squirrel:nut GraphvizDot=Graphviz_DOT:gv,dot""",
    "c nested": "Kotlin:kt,kts Scala:sc,scala Swift:swift Dart:dart Odin:odin WGSL:wgsl Ceylon:ceylon Stratego=Stratego/XT:str",
    "c two": "Groovy:gradle,grt,gtpl,groovy Vala:vala ArkTS:ets Pan:pan,tpl AspNet=ASP.NET:asax,ascx,asmx,aspx,master,sitemap,webinfo Jsonnet:jsonnet,libsonnet ReScript:res,resi Qml=QML:qml",
    "c bare": " RON=Rusty_Object_Notation:ron",
    "js": "JavaScript:cjs,js,mjs Jsx=JSX:jsx TypeScript:ts,mts,cts Tsx=TSX:tsx GlimmerJs=Glimmer_JS:gjs GlimmerTs=Glimmer_TS:gts Go:go",
    "slashes": "K:k Q:q",
    "slashes quoted": "Zig:zig Gleam:gleam Wenyan:wy JSLT:jslt",
    "css": "Css=CSS:css",
    "sass": "Sass:sass,scss Less:less Stylus:styl PostCss=PostCSS:pcss,sss",
    "hash": """Yaml=YAML:yaml,yml Dockerfile=Dockerfile:dockerfile,dockerignore@dockerfile Makefile:makefile,mak,mk@makefile,gnumakefile Automake:am Hex0:hex0 Hex1_=x Kaem:kaem Gherkin=Gherkin_(Cucumber):feature Po=PO_File:po,pot
        UrWebProject=Ur/Web_Project:urp DotEnv=.env:env VerilogArgsFile=Verilog_Args_File:irunargs,xrunargs RPMSpecfile=RPM_Specfile:spec AWK:awk Ignore=Ignore_List:gitignore,ignore""",
    "hash one": """Perl:pl,pm Tcl:tcl Jq=jq:jq Uiua:ua BQN:bqn Gdb=GDB_Script:gdb Elvish:elv Hex2_=x OpenPolicyAgent=Open_Policy_Agent:rego D2:d2 Just:just@justfile Ksh:ksh Toml=TOML:toml
        OpenType=OpenType_Feature_File:fea R:r""",
    "hash two": """Sh=Shell:sh Bash=BASH:bash Zsh:zsh Fish:fish CShell=C_Shell:csh Nushell:nu EdgeQL:edgeql ESDL:esdl Ebuild:ebuild,eclass PacmanMakepkg=Pacman's_makepkg@pkgbuild Bitbake=Bitbake:bb,bbclass,bbappend,inc Rakefile:rake@rakefile
        Meson@meson.build,meson_options.txt KakouneScript=Kakoune_script:kak Kvlanguage=KV_Language:kv Puppet:pp RenPy=Ren'Py:rpy""",
    "semicolon": "ABNF:abnf ModuleDef=Module-Definition:def Assembly:asm Ini=INI:ini Spice=Spice_Netlist:ckt Edn:edn",
    "semicolon quoted": "LLVM:ll Cil=CIL_(SELinux):cil Clojure:clj ClojureC:cljc ClojureScript:cljs Elisp=Emacs_Lisp:el EmacsDevEnv=Emacs_Dev_Env:ede Fennel:fnl,fnlm Srecode=SRecode_Template:srt Arturo:art Hy:hy",
    "lisp": "Scheme:scm,ss Racket:rkt Lisp=Common_Lisp:lisp,lsp,asd",
    "ml": "OCaml:ml,mli Sml=Standard_ML_(SML):sml Coq:v Urweb=Ur/Web:ur,urs",
    "dash": "Ada:ada,adb,ads,pad Asn1=ASN.1:asn1 Cogent:cogent",
    "haskell": "Haskell:hs Elm:elm Agda:agda Idris:idr,lidr PureScript:purs Dhall:dhall Unison:u Daml:daml",
    "sql": "Sql=SQL:sql",
    "xml": """Html=HTML:html,htm Xml=XML:xml Svg=SVG:svg Xsl=XSL:xsl,xslt Xaml=XAML:xaml AvaloniaXaml=AXAML:axaml MsBuild=MSBuild:csproj,vbproj,fsproj,props,targets DotNetResource=.NET_Resource:resx NuGetConfig=NuGet_Config@nuget.config,packages.config,nugetdefaults.config
        VisualStudioProject=Visual_Studio_Project:vcproj,vcxproj""",
    "percent": "Erlang:erl,hrl Tex=TeX:tex,sty Prolog:p,pro PostScript:ps",
    "basic": "VB6=VB6:frm,bas,cls VBScript=VBScript:vbs VisualBasic=Visual_Basic:vb BrightScript:brs",
    "prose": "Markdown:md,markdown Mdx=MDX:mdx Djot:dj UnrealDeveloperMarkdown=Unreal_Markdown:udn",
    "org": "Org:org",
}

#: Languages with a syntax of their own: fields as in a class, and ``ext``, ``files``, ``name``.
OWN = {
    "DreamMaker": {"base": "c nested", "quotes": "\" \" {\" \"} ' '", "name": "Dreammaker", "ext": "dm,dme"},
    "D2": {"line": "#", "block": '""" """', "quotes": "", "ext": "d2"},
    "Dhall": {"base": "haskell", "quotes": "\" \" '' ''", "ext": "dhall"},
    "Daml": {"base": "haskell", "line": "--␠", "ext": "daml"},
    "LinguaFranca": {"line": "// #", "block": "/* */", "quotes": '" "', "doc": "\"\"\" \"\"\" ''' '''", "name": "Lingua Franca", "ext": "lf"},
    "Q": {"line": "/", "quotes": '" "', "ext": "q"},
    "K": {"line": "/", "quotes": '" "', "ext": "k"},
    "Jsonnet": {"line": "// #", "block": "/* */", "quotes": "\" \" ' '", "ext": "jsonnet,libsonnet"},
    "CppModule": {"base": "c", "verbatim": 'R"( )"', "name": "C++ Module", "ext": "cppm,ixx,ccm,mpp,mxx"},
    "CppHeader": {"base": "c", "verbatim": 'R"( )"', "name": "C++ Header", "ext": "hh,hpp,hxx,inl,ipp"},
    "Raku": {"line": "#", "block": "#`( ) #`[ ] #`{ } #`「 」", "quotes": "\" \" ' '", "doc": "#|{ } #={ } #|( ) #=( ) #|[ ] #=[ ] =begin␠pod =end␠pod =begin␠code =end␠code =begin␠head =end␠head =begin␠item =end␠item =begin␠table =end␠table =begin␠para =end␠para =begin␠comment =end␠comment", "verbatim": "「 」", "ext": "raku,rakumod,rakutest,pm6,pl6,p6"},
    "GlimmerTs": {"line": "//", "block": "/* */ <!-- -->", "quotes": "\" \" ' ' ` `", "name": "Glimmer TS", "ext": "gts"},
    "GlimmerJs": {"line": "//", "block": "/* */ <!-- -->", "quotes": "\" \" ' ' ` `", "name": "Glimmer JS", "ext": "gjs"},
    "Pan": {"line": "#", "quotes": "\" \" ' '", "ext": "pan,tpl"},
    "Org": {"line": "#␠", "literate": False, "ext": "org"},
    "Kvlanguage": {"line": "#␠", "quotes": "\" \" ' '", "name": "KV Language", "ext": "kv"},
    "Cangjie": {"base": "c nested", "quotes": '" " """ """', "verbatim": '##" "## #" "#', "ext": "cj"},
    "BallerinaLang": {"line": "// #", "quotes": '" " ` `', "name": "Ballerina", "ext": "bal"},
    "Asn1": {"line": "--", "block": "/* */", "quotes": '" "', "name": "ASN.1", "ext": "asn1"},
    "Rust": {"line": "//", "block": "/* */", "nested": True, "quotes": '" "', "verbatim": 'r##" "## r#" "#', "ext": "rs"},
    "Python": {"base": "python", "ext": "py,pyw,pyi"},
    "Cython": {"base": "python", "ext": "pyx,pxd,pxi"},
    "Mojo": {"base": "python", "ext": "mojo,🔥"},
    "Bazel": {"base": "python", "ext": "bzl,bazel,bzlmod", "files": "build,workspace,module"},
    "Scons": {"base": "python", "name": "SCons", "files": "sconstruct,sconscript"},
    "Snakemake": {"base": "python", "ext": "smk,rules", "files": "snakefile"},
    "RenPy": {"line": "#", "quotes": "\" \" ' ' ` `", "name": "Ren'Py", "ext": "rpy"},
    "Jupyter": {"name": "Jupyter Notebooks", "ext": "ipynb"},
    "Cpp": {"verbatim": 'R"( )"'},
    "CSharp": {"verbatim": '@" "'},
    "D": {"line": "//", "block": "/* */", "inner": "/+ +/", "quotes": '" "', "ext": "d"},
    "Go": {"line": "//", "block": "/* */", "quotes": '" "', "verbatim": "` `", "ext": "go"},
    "Php": {"line": "# //", "block": "/* */", "quotes": "\" \" ' '", "name": "PHP", "ext": "php4,php5,php,phtml"},
    "Ruby": {"line": "#", "block": "=begin =end", "quotes": "\" \" ' '", "ext": "rb"},
    "Crystal": {"line": "#", "quotes": "\" \" ' '", "ext": "cr"},
    "Perl": {"line": "#", "block": "=pod =cut", "quotes": "\" \" ' '", "ext": "pl,pm"},
    "Nqp": {"line": "#", "block": "=begin =end", "quotes": "\" \" ' '", "name": "NQP", "ext": "nqp"},
    "Lua": {"line": "--", "block": "--[[ ]]", "quotes": "\" \" ' '", "ext": "lua,luau"},
    "MoonScript": {"line": "--", "quotes": "\" \" ' '", "ext": "moon"},
    "Nim": {"line": "#", "block": "#[ ]#", "nested": True, "quotes": '" "', "doc": '""" """', "ext": "nim"},
    "Julia": {"line": "#", "block": "#= =#", "nested": True, "quotes": '" "', "doc": '""" """', "ext": "jl"},
    "CoffeeScript": {"line": "#", "block": "### ###", "quotes": "\" \" ' '", "ext": "coffee,cjsx", "files": "cakefile"},
    "LiveScript": {"line": "#", "block": "/* */", "quotes": "\" \" ' '", "ext": "ls"},
    "Elixir": {"line": "#", "quotes": "\" \" ' '", "doc": "\"\"\" \"\"\"", "ext": "ex,exs"},
    "R": {"line": "#", "quotes": "\" \" ' '", "ext": "r"},
    "Tcl": {"line": "#", "quotes": '" "', "name": "TCL", "ext": "tcl"},
    "Smalltalk": {"quotes": "' '", "block": '" "', "ext": "cs.st,pck.st"},
    "Stata": {"line": "// *", "block": "/* */", "ext": "do"},
    "Batch": {"line": "REM ::", "ext": "bat,btm,cmd"},
    "PowerShell": {"line": "#", "block": "<# #>", "quotes": "\" \" ' '", "verbatim": '@" "@ @\' \'@', "ext": "ps1,psm1,psd1,ps1xml,cdxml,pssc,psc1"},
    "AutoHotKey": {"line": ";", "block": "/* */", "name": "AutoHotKey", "ext": "ahk"},
    "Autoit": {"line": ";", "block": "#comments-start #comments-end #cs #ce", "ext": "au3"},
    "VimScript": {"line": '"', "quotes": "\" \" ' '", "name": "Vim Script", "ext": "vim", "files": ".vimrc,vimrc"},
    "FortranModern": {"line": "!", "quotes": '" "', "name": "FORTRAN Modern", "ext": "f03,f08,f90,f95,fpp"},
    "FortranLegacy": {"line": "c C ! *", "quotes": "\" \" ' '", "name": "FORTRAN Legacy", "ext": "f,for,ftn,f77,pfo"},
    "Pascal": {"line": "//", "block": "{ } (* *)", "nested": True, "quotes": "' '", "ext": "pas,lpr"},
    "WebAssembly": {"line": ";;", "ext": "wat,wast"},
    "FSharp": {"line": "//", "block": "(* *)", "quotes": '" "', "verbatim": '@" "', "name": "F#", "ext": "fs,fsi,fsx,fsscript"},
    "Fstar": {"line": "//", "block": "(* *)", "quotes": '" "', "name": "F*", "ext": "fst,fsti"},
    "Asp": {"line": "' REM", "name": "ASP", "ext": "asa,asp"},
    "VB6": {"line": "'", "quotes": '" "', "name": "VB6", "ext": "frm,bas,cls"},
    "VBScript": {"line": "' REM", "quotes": '" "', "ext": "vbs"},
    "BrightScript": {"line": "' REM", "quotes": '" "', "ext": "brs"},
    "VisualBasic": {"line": "'", "quotes": '" "', "name": "Visual Basic", "ext": "vb"},
    "Janet": {"line": "#", "quotes": '" "', "doc": "``` ```", "verbatim": "` `", "ext": "janet"},
    "Roc": {"line": "#", "quotes": '" "', "verbatim": '""" """', "name": "Roc", "ext": "roc"},
    "Futhark": {"line": "--", "ext": "fut"},
    "Lean": {"line": "--", "block": "/- -/", "nested": True, "ext": "lean,hlean"},
    "Isabelle": {"line": "--", "block": "{* *} (* *) ‹ › \\<open> \\<close>", "quotes": "'' ''", "ext": "thy"},
    "PRQL": {"line": "#", "quotes": "\" \" ' '", "ext": "prql"},
    "Graphql": {"line": "#", "quotes": '" "', "doc": '""" """', "name": "GraphQL", "ext": "gql,graphql"},
    "Thrift": {"line": "# //", "block": "/* */", "quotes": "\" \" ' '", "ext": "thrift"},
    "EdgeQL": {"line": "#", "quotes": "\" \" ' '", "verbatim": "$$ $$", "ext": "edgeql"},
    "ESDL": {"line": "#", "quotes": "\" \" ' '", "name": "EdgeDB Schema Definition", "ext": "esdl"},
    "Hledger": {"line": "; #", "block": "comment end␠comment", "name": "hledger", "ext": "hledger"},
    "Bean": {"line": ";", "quotes": '" "', "ext": "bean,beancount"},
    "Sql": {"line": "--", "block": "/* */", "quotes": "' '", "name": "SQL", "ext": "sql"},
    "Vhdl": {"line": "--", "block": "/* */", "name": "VHDL", "ext": "vhd,vhdl"},
    "Spice": {"line": "* ;", "name": "Spice Netlist", "ext": "ckt"},
    "GdShader": {"base": "c bare", "name": "GDShader", "ext": "gdshader"},
    "Handlebars": {"block": "<!-- --> {{! }}", "quotes": "\" \" ' '", "ext": "hbs,handlebars"},
    "Mustache": {"block": "{{! }}", "quotes": "\" \" ' '", "ext": "mustache"},
    "Pug": {"line": "//", "quotes": "#{\" \"} #{' '} #{` `}", "ext": "pug"},
    "Haml": {"line": "-#", "quotes": "\" \" ' '", "ext": "haml"},
    "Liquid": {"block": "<!-- --> {%␠comment␠%} {%␠endcomment␠%}", "quotes": "\" \" ' '", "ext": "liquid"},
    "Twig": {"block": "<!-- --> {# #}", "quotes": "\" \" ' '", "ext": "twig"},
    "Jinja2": {"block": "{# #}", "name": "Jinja2", "ext": "j2,jinja"},
    "Tera": {"block": "<!-- --> {# #}", "quotes": "\" \" ' '", "ext": "tera"},
    "FreeMarker": {"block": "<#-- -->", "ext": "ftl,ftlh,ftlx"},
    "Velocity": {"line": "##", "block": "#* *#", "quotes": "\" \" ' '", "name": "Apache Velocity", "ext": "vm"},
    "Blade": {"block": "{{-- --}} <!-- -->", "quotes": "\" \" ' '", "name": "Blade", "suffixes": ".blade.php"},
    "Razor": {"line": "//", "block": "<!-- --> @* *@ /* */", "quotes": "\" \" ' '", "ext": "cshtml"},
    "RazorComponent": {"line": "//", "block": "<!-- --> @* *@ /* */", "quotes": "\" \" ' '", "name": "Razor Component", "ext": "razor"},
    "Gohtml": {"block": "<!-- --> {{/* */}}", "quotes": "\" \" ' '", "name": "Go HTML", "ext": "gohtml"},
    "RubyHtml": {"block": "<!-- -->", "quotes": "\" \" ' '", "name": "Ruby HTML", "ext": "erb,rhtml"},
    "Templ": {"line": "//", "block": "<!-- --> /* */", "quotes": "\" \" ' ' ` `", "ext": "templ"},
    "Dust": {"block": "{! !}", "name": "Dust.js", "ext": "dust"},
    "Vue": {"line": "//", "block": "<!-- --> /* */", "quotes": "\" \" ' ' ` `", "ext": "vue"},
    "Svelte": {"line": "//", "block": "<!-- --> /* */", "quotes": "\" \" ' ' ` `", "ext": "svelte"},
    "Astro": {"line": "//", "block": "/* */ <!-- -->", "quotes": "\" \" ' ' ` `", "ext": "astro"},
    "ReStructuredText": {"literate": True, "ext": "rst"},
    "Text": {"literate": True, "name": "Plain Text", "ext": "text,txt"},
    "AsciiDoc": {"line": "//", "block": "//// ////", "ext": "adoc,asciidoc"},
    "Typst": {"base": "c", "ext": "typ"},
    "PlantUml": {"line": "'", "block": "/' '/", "quotes": '" "', "name": "PlantUML", "ext": "puml"},
    "Hcl": {"base": "hash c", "name": "HCL", "ext": "hcl,tf,tfvars"},
    "Cue": {"line": "//", "quotes": "\" \" ' '", "doc": "\"\"\" \"\"\" ''' '''", "verbatim": '#" "#', "name": "CUE", "ext": "cue"},
    "Nix": {"line": "#", "block": "/* */", "quotes": '" "', "ext": "nix"},
    "ForgeConfig": {"line": "# ~", "name": "Forge Config", "ext": "cfg"},
    "VisualStudioSolution": {"name": "Visual Studio Solution", "ext": "sln"},
    "UnrealPlugin": {"name": "Unreal Plugin", "ext": "uplugin"},
    "UnrealProject": {"name": "Unreal Project", "ext": "uproject"},
    "CMake": {"line": "#", "quotes": '" "', "ext": "cmake", "files": "cmakelists.txt"},
    "Autoconf": {"line": "# dnl", "ext": "in"},
    "M4": {"line": "# dnl", "quotes": "` '", "ext": "m4"},
    "Cabal": {"line": "--", "block": "{- -}", "nested": True, "ext": "cabal"},
    "Racket": {"line": ";", "block": "#| |#", "nested": True, "quotes": '" "', "ext": "rkt,scrbl"},
    "Arturo": {"line": ";", "quotes": '" "', "ext": "art"},
    "Ats": {"line": "//", "block": "(* *) /* */", "quotes": '" "', "name": "ATS", "ext": "dats,hats,sats,atxt"},
    "Alloy": {"line": "-- //", "block": "/* */", "ext": "als"},
    "Apl": {"line": "⍝", "quotes": "' '", "name": "APL", "ext": "apl,aplf,apls"},
    "EightTh": {"line": "\\\\ --", "inner": "(* *)", "quotes": '" "', "name": "8th", "ext": "8th"},
    "Factor": {"line": "! #!", "block": "/* */", "ext": "factor"},
    "Pyret": {"line": "#", "block": "#| |#", "nested": True, "quotes": "\" \" ' '", "ext": "arr"},
    "Phix": {"line": "-- //", "block": "/* */ --/* --*/", "nested": True, "quotes": "\" \" ' '", "verbatim": '""" """ ` `', "ext": "e,exw"},
    "LolCode": {"line": "BTW", "block": "OBTW TLDR", "quotes": '" "', "name": "LOLCODE", "ext": "lol"},
    "Hicad": {"line": "REM rem", "name": "HICAD", "ext": "mac"},
    "Umpl": {"line": "!", "quotes": "` `", "name": "UMPL", "ext": "umpl"},
    "Gwion": {"line": "#!", "quotes": '" "', "ext": "gw"},
    "Hex1": {"line": "; #", "ext": "hex1"},
    "Hex0": {"line": "; #", "ext": "hex0"},
    "Hex2": {"line": "; #", "ext": "hex2"},
    "M1Assembly": {"line": "; #", "quotes": "\" \" ' '", "name": "M1 Assembly", "ext": "m1"},
    "Menhir": {"line": "//", "block": "(* *) /* */", "nested": True, "quotes": '" "', "ext": "mll,mly,vy"},
    "Pest": {"line": "//", "quotes": "\" \" ' '", "ext": "pest"},
    "Pony": {"line": "//", "block": "/* */", "quotes": '" "', "doc": '""" """', "ext": "pony"},
    "Mlatu": {"line": "//", "quotes": '" "', "ext": "mlt"},
    "Ttcn": {"base": "c", "name": "TTCN-3", "ext": "ttcn,ttcn3,ttcnpp"},
    "Logtalk": {"line": "%", "block": "/* */", "quotes": '" "', "ext": "lgt,logtalk"},
    "Toml": {"line": "#", "quotes": "\" \" ' '", "verbatim": "''' ''' \"\"\" \"\"\"", "name": "TOML", "ext": "toml"},
    "SystemVerilog": {"name": "SystemVerilog", "base": "c", "ext": "sv,svh"},
}

#: The families and their languages.
FAMILIES: dict[str, tuple[str, ...]] = {
    "JavaScript": (
        "JavaScript", "TypeScript", "Jsx", "Tsx", "ArkTS", "CoffeeScript", "LiveScript", "ReScript", "Elm", "Svelte", "Vue", "Astro",
        "GlimmerJs", "GlimmerTs", "Qml",
    ),
    "Web": (
        "Html", "Css", "Sass", "Less", "Stylus", "PostCss", "Svg", "Handlebars", "Mustache", "Pug", "Haml", "Liquid", "Twig",
        "Jinja2", "Tera", "FreeMarker", "Velocity", "Blade", "Razor", "Gohtml", "RubyHtml", "Templ", "Slint", "Dust",
    ),
    "Documentation": (
        "Markdown", "Mdx", "ReStructuredText", "Text", "AsciiDoc", "Org", "Djot", "Tex", "Typst", "PlantUml", "D2", "Gherkin", "Po",
        "UnrealDeveloperMarkdown",
    ),
    "Configuration": (
        "Json", "Yaml", "Toml", "Ini", "Xml", "Hcl", "Dhall", "Cue", "Jsonnet", "Edn", "RON", "Nix", "Bicep", "OpenPolicyAgent",
        "Puppet", "Xaml", "AvaloniaXaml", "NuGetConfig", "XcodeConfig", "ForgeConfig", "DotNetResource", "MsBuild",
        "VisualStudioProject", "VisualStudioSolution", "UnrealPlugin", "UnrealProject", "ModuleDef", "DeviceTree", "LinkerScript",
    ),
    "Build": (
        "Makefile", "CMake", "Dockerfile", "Bazel", "Meson", "Just", "Scons", "Autoconf", "Automake", "M4", "Cabal", "Ebuild",
        "PacmanMakepkg", "RPMSpecfile", "Rakefile", "Bitbake", "Nextflow", "Snakemake",
    ),
    "Shell": (
        "Sh", "Bash", "Zsh", "Fish", "Ksh", "CShell", "Elvish", "Nushell", "PowerShell", "Batch", "AWK", "AutoHotKey", "Autoit",
        "VimScript", "KakouneScript",
    ),
    "Systems": (
        "C", "CHeader", "Cpp", "CppHeader", "CppModule", "Rust", "Zig", "Go", "D", "Nim", "Odin", "Vala", "Ada", "Pascal",
        "FortranLegacy", "FortranModern", "Assembly", "AssemblyGAS", "LLVM", "WebAssembly", "ObjectiveC", "ObjectiveCpp", "Swift",
        "Cuda", "OpenCL", "HolyC", "Virgil", "C3", "Jai",
    ),
    "JVM": (
        "Java", "Kotlin", "Scala", "Groovy", "Clojure", "ClojureC", "ClojureScript", "Xtend", "Ceylon", "Gleam",
    ),
    "DotNet": (
        "CSharp", "FSharp", "VisualBasic", "VB6", "VBScript", "Cil", "Asp", "AspNet",
    ),
    "Scripting": (
        "Python", "Cython", "Jupyter", "Mojo", "Ruby", "Perl", "Raku", "Php", "Lua", "Tcl", "MoonScript", "Hy", "Elisp", "Janet",
        "Fennel", "Scheme", "Racket", "Lisp", "Smalltalk", "Crystal", "Dart", "Julia", "R", "Stata", "Erlang", "Elixir", "Haxe",
        "ActionScript",
    ),
    "Functional": (
        "Haskell", "OCaml", "Sml", "PureScript", "Idris", "Agda", "Coq", "Lean", "Isabelle", "Unison", "Roc", "Koka", "Futhark",
        "Fstar",
    ),
    "Data": (
        "Sql", "PRQL", "Graphql", "Protobuf", "Thrift", "FlatBuffers", "Asn1", "EdgeQL", "ESDL", "JSLT", "Jq", "Hledger", "Bean",
        "Stan",
    ),
    "Hardware": (
        "Verilog", "VerilogArgsFile", "SystemVerilog", "Vhdl", "Glsl", "Hlsl", "WGSL", "Metal", "Slang", "ShaderLab", "GdShader",
        "Spice", "OpenQasm", "Qcl",
    ),
}

#: Paths that mark whole files as tests, and for each language its own and the line starts that open a region of tests.
TEST_PATHS = ("**/tests/**", "**/test/**", "**/__tests__/**", "**/testdata/**", "**/spec/**", "**/specs/**", "**/__mocks__/**", "**/fixtures/**", "**/*.snap")
TESTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Rust": (("**/tests/**", "**/benches/**"), ("#[cfg(test)]", "#[test]", "#[tokio::test]", "#[bench]", "#[rstest]", "#[test_case")),
    "Go": (("**/*_test.go",), ("func Test", "func Benchmark", "func Fuzz", "func Example")),
    "Python": (("**/test_*.py", "**/*_test.py", "**/conftest.py"), ("def test_", "async def test_", "class Test")),
    "JavaScript": (
        ("**/*.test.js", "**/*.spec.js", "**/*.test.mjs", "**/*.spec.mjs", "**/*.test.cjs", "**/*.spec.cjs"),
        ("describe(", "describe.each", "it(", "it.each", "test(", "test.each", "suite(", "bench("),
    ),
    "Jsx": (("**/*.test.jsx", "**/*.spec.jsx"), ("describe(", "it(", "test(", "suite(")),
    "TypeScript": (
        ("**/*.test.ts", "**/*.spec.ts", "**/*.test.mts", "**/*.spec.mts"),
        ("describe(", "describe.each", "it(", "it.each", "test(", "test.each", "suite(", "bench("),
    ),
    "Tsx": (("**/*.test.tsx", "**/*.spec.tsx"), ("describe(", "it(", "test(", "suite(")),
    "Java": (("**/src/test/**", "**/*Test.java", "**/*Tests.java", "**/Test*.java"), ("@Test", "@ParameterizedTest", "@RepeatedTest")),
    "Kotlin": (("**/src/test/**", "**/*Test.kt", "**/*Tests.kt"), ("@Test", "@ParameterizedTest")),
    "Scala": (("**/src/test/**", "**/*Test.scala", "**/*Spec.scala"), ()),
    "CSharp": (("**/*Test.cs", "**/*Tests.cs", "**/*.Tests/**"), ("[Test]", "[TestMethod]", "[Fact]", "[Theory]")),
    "Ruby": (("**/*_spec.rb", "**/*_test.rb"), ()),
    "Php": (("**/*Test.php", "**/tests/**"), ()),
    "Swift": (("**/*Tests.swift", "**/*Test.swift"), ("func test", "@Test")),
    "Elixir": (("**/test/**", "**/*_test.exs"), ('test "', 'describe "')),
    "C": (("**/*_test.c", "**/test_*.c"), ()),
    "Cpp": (("**/*_test.cpp", "**/*_test.cc", "**/test_*.cpp"), ("TEST(", "TEST_F(", "TEST_P(", "TYPED_TEST(", "BENCHMARK(")),
    "Zig": ((), ('test "',)),
    "Lua": (("**/*_spec.lua", "**/*_test.lua"), ()),
    "Haskell": (("**/test/**", "**/*Spec.hs"), ()),
}
INDENTED = ("Python", "Elixir")


def merged(base: dict, overlay: dict) -> dict:
    """Dictionaries merge key by key; any other value of the overlay takes the place of the base's."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def definitions() -> dict[str, dict]:
    """Plain fields of every language by key."""
    found: dict[str, dict] = {}
    for kind, listed in LANGUAGES.items():
        for entry in listed.split():
            head, _, files = entry.partition("@")
            head, _, ext = head.partition(":")
            key, _, name = head.partition("=")
            found[key] = {**CLASSES[kind], "name": name.replace("_", " ") or key, "ext": ext, "files": files}
    for key, fields in OWN.items():
        known = found.get(key, {"name": key, "ext": "", "files": ""})
        syntax = CLASSES[fields["base"]] if "base" in fields else {}
        found[key] = {**known, **syntax, **{k: v for k, v in fields.items() if k != "base"}}
    for key, (paths, blocks) in TESTS.items():
        found[key] |= {"test_paths": paths, "test_blocks": blocks, "indent_style": key in INDENTED}
    return found


def _unescaped(text: str) -> str:
    """A delimiter as it is written: the sign for a blank becomes one, a backslash gives the character behind it."""
    return re.sub(r"\\(.?)", r"\1", text.replace("␠", " "), flags=re.S)


def _pairs(value: str) -> Pairs:
    parts = [_unescaped(p) for p in value.split()]
    return tuple(sorted(zip(parts[::2], parts[1::2], strict=True), key=lambda p: -len(p[0])))


@dataclass(frozen=True)
class Registry:
    """All languages by key, in key order, with the lookups that need them."""

    languages: dict[str, Language]
    families: dict[str, tuple[str, ...]]
    test_paths: tuple[str, ...] = TEST_PATHS
    _cache: dict = field(default_factory=dict, compare=False)

    @classmethod
    def build(cls, overlay: dict | None = None, families: dict | None = None) -> Registry:
        """The registry; ``overlay`` may have ``languages`` and ``global.test_paths``. A family's unknown or twice listed key is an error."""
        overlay = overlay or {}
        members = {f: tuple(k.split() if isinstance(k, str) else k) for f, k in (families or FAMILIES).items()}
        fields = merged(definitions(), overlay.get("languages", {}))
        owner: dict[str, str] = {}
        for family, keys in members.items():
            for key in keys:
                if key not in fields:
                    raise ValueError(f"family {family} lists the unknown language {key}")
                if owner.setdefault(key, family) != family:
                    raise ValueError(f"language {key} is in the families {owner[key]} and {family}")
        split = lambda v: tuple(x for x in v.split(",") if x) if isinstance(v, str) else tuple(v)
        made = {}
        for key in sorted(fields):
            f = fields[key]
            made[key] = Language(
                key, f.get("name", key), tuple(sorted(map(_unescaped, f.get("line", "").split()), key=lambda x: -len(x))),
                *(_pairs(f.get(k, "")) for k in ("block", "inner", "quotes", "doc", "verbatim")),
                f.get("nested", False), f.get("literate", False), split(f.get("ext", "")), split(f.get("files", "")), split(f.get("suffixes", "")),
                tuple(f.get("test_paths", ())), tuple(f.get("test_blocks", ())), f.get("indent_style", False), owner.get(key, OTHER),
            )
        return cls(made, members, tuple(overlay.get("global", {}).get("test_paths", TEST_PATHS)))

    @cached_property
    def by_extension(self) -> dict[str, str]:
        return self._first("extensions")

    @cached_property
    def by_filename(self) -> dict[str, str]:
        return self._first("filenames")

    @cached_property
    def by_suffix(self) -> list[tuple[str, str]]:
        return sorted(((s, k) for k, x in self.languages.items() for s in x.suffixes), key=lambda p: -len(p[0]))

    def _first(self, name: str) -> dict[str, str]:
        found: dict[str, str] = {}
        for key, language in self.languages.items():
            for value in getattr(language, name):
                found.setdefault(value, key)
        return found

    def from_path(self, path: str) -> str | None:
        """By the lower-cased base name, then a suffix of it, then its extension."""
        base = path.rsplit("/", 1)[-1]
        low = base.lower()
        if key := self.by_filename.get(low):
            return key
        if key := next((k for s, k in self.by_suffix if low.endswith(s)), None):
            return key
        ext = extension(base)
        return None if ext is None else self.by_extension.get(ext.lower())

    def from_shebang(self, head: bytes) -> str | None:
        """By the first line of the first 128 bytes, which must be UTF-8."""
        line = head[:128].split(b"\n", 1)[0]
        if not line.startswith(b"#!"):
            return None
        try:
            words = line[2:].decode().split()
        except UnicodeDecodeError:
            return None
        if not words:
            return None
        program = words[0].rsplit("/", 1)[-1]
        if program == "env":
            if len(words) < 2:
                return None
            program = words[1].rsplit("/", 1)[-1]
        stem = re.match(r"[A-Za-z]*", program)[0].lower()
        return next((k for k, x in self.languages.items() if stem and stem in (k.lower(), *map(str.lower, x.extensions))), None)

    def resolve(self, name: str) -> str | None:
        """A language by key or name in any case, else by extension."""
        low = name.lower()
        return next((k for k, x in self.languages.items() if low in (k.lower(), x.name.lower())), None) or self.by_extension.get(low)

    def resolve_family(self, name: str) -> str | None:
        return next((f for f in self.families if f.lower() == name.lower()), None)


def extension(base: str) -> str | None:
    """What stands behind a base name's last dot; none without a dot or with a leading one only."""
    head, dot, tail = base.rpartition(".")
    return tail if dot and head else None


_default: list[Registry] = []


def registry() -> Registry:
    if not _default:
        _default.append(Registry.build())
    return _default[0]
